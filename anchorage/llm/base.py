"""What the operators share: tables in the shared folder, key bitmaps, hashing."""

from __future__ import annotations

import ctypes
import functools
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that texts are compared without, and that words are split at.
BLANKS = " \t\n\v\f\r"
BLANK_BYTES = BLANKS.encode()
#: A key bitmap has at most so many bits (16 MiB), whatever the number of keys.
MAX_BITMAP_BITS = 1 << 27
#: Seconds between two times that the driver gives free memory back.
RELIEF_S = 3.0
_relieved = -RELIEF_S


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder in the
    warehouse, which they share too, where a session has none."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/anchorage"


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    ``save`` writes and rereads; ``drop`` deletes tables that no later result reads. What is
    left goes when the driver's JVM ends, also where the session has been stopped before.
    """

    def __init__(self, spark: SparkSession, name: str = "anchorage"):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        p, system = _path(spark, self.root)
        system.mkdirs(p)
        system.deleteOnExit(p)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        relieve(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            p, system = _path(self.spark, df._scratch_path)
            system.delete(p, True)


def without(df: DataFrame, *results: str) -> DataFrame:
    """df without columns that have the name of a result, in any case: they give way to it."""
    names = {r.lower() for r in results}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory back to the system when it ends: idle Python workers else hold theirs
    while the next stage needs it."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return tidied


def _trim() -> None:
    """Gives free memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def relieve(spark: SparkSession) -> bool:
    """Gives free native memory of the driver, its Python and its JVM, back to the system, at most
    once in RELIEF_S; whether it did.

    Compiling the code of many plans in many threads leaves the JVM's C library with hundreds of
    MB that it holds but does not use. A JVM without that command keeps them.
    """
    global _relieved
    if time.monotonic() - _relieved < RELIEF_S:
        return False
    _trim()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    of = jvm.java.lang.Class.forName
    kinds = [of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;")]
    types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, x in enumerate(kinds):
        types[i] = x
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface's method: the server's own class is closed to callers
        of("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:  # another JVM or C library
        return False
    finally:
        _relieved = time.monotonic()
    return True


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys: 32 a key, at most MAX_BITMAP_BITS."""
    return min(MAX_BITMAP_BITS, max(1 << 15, 1 << (max(1, 32 * keys) - 1).bit_length()))


def key_bitmap(df: DataFrame, key: Column, bits: int) -> np.ndarray:
    """Sets bit ``key mod bits`` for each row's long key; built by executors, at most 16 MiB.

    A superset test: a clear bit proves that a key is absent, so a full bitmap costs speed only.
    """
    at = F.pmod(key, F.lit(bits)) + 1
    rows = (
        df.select(at.alias("at"))
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64) % (len(bitmap) * 8)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64) on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
