"""Dumps, shards and tables: readers, page filters, counters, writers."""

from __future__ import annotations

import logging
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.markup import cleaned

log = logging.getLogger(__name__)

PAGE = T.StructType().add("title", "string").add("ns", "string").add("id", "long").add("revision", T.StructType().add("text", "string"))
SHARD = "title string, text string"
SHARD_ROWS = 50_000
SHARD_GLOB, SHARD_NAME = "wiki_shard_*.parquet", "wiki_shard_%05d.parquet"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
DATASET = "text string, input array<int>, attention_mask array<int>, offset_mapping array<struct<start:int,end:int>>, output array<int>"
_JSON = ("input", "attention_mask", "offset_mapping", "output")


def read_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``page_id, title, text`` of a dump's article pages (namespace 0), bz2 or plain XML.

    Blanks are kept. The row-tag reader doesn't split a bz2 file, so rows are dealt anew right
    after the scan; give a multi-file dump as a folder or glob to read files side by side.
    """
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    rows = raw.where(F.col("ns") == "0").select(F.coalesce("id", F.lit(0)).alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("revision.text", F.lit("")).alias("text"))
    return rows.repartition(partitions or spark.sparkContext.defaultParallelism)


def is_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def is_redirect(c: Column) -> Column:
    """Begins with the redirect word, in any case, without blanks before it."""
    return c.rlike(r"\A(?i)#redirect")


def articles(pages: DataFrame, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Pages with text that are no redirects and whose title isn't done yet; at most limit of them."""
    rows = pages.where(~is_empty(F.col("text")) & ~is_redirect(F.col("text")))
    if done is not None:
        rows = rows.join(done.select("title"), "title", "left_anti")
    return rows if limit is None else rows.limit(limit)


def extract(pages: DataFrame, done: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned ``title, text`` and the pages that failed, ``title, error``. An empty result is kept."""
    rows = cleaned(articles(pages, done, limit))
    return rows.where("error is null").select("title", "text"), rows.where("error is not null").select("title", "error")


def counters(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One row: pages, empty, redirects, already_done, to_clean, in one pass."""
    rows = pages
    seen = F.lit(False)
    if done is not None:
        rows = rows.join(done.select("title").distinct().withColumn("_done", F.lit(True)), "title", "left")
        seen = F.coalesce("_done", F.lit(False))
    empty, redirect = is_empty(F.col("text")), ~is_empty(F.col("text")) & is_redirect(F.col("text"))
    return rows.agg(
        F.count("*").alias("pages"),
        F.count_if(empty).alias("empty"),
        F.count_if(redirect).alias("redirects"),
        F.count_if(~empty & ~redirect & seen).alias("already_done"),
        F.count_if(~empty & ~redirect & ~seen).alias("to_clean"),
    )


def log_errors(errors: DataFrame, most: int = 50) -> int:
    """Logs the first errors, by title; returns how many were logged."""
    rows = errors.orderBy("title").limit(most).collect()
    for r in rows:
        log.warning("%s: %s", r.title, r.error)
    return len(rows)


def format_duration(seconds: float) -> str:
    """Hours, minutes and seconds."""
    whole = int(seconds)
    return ":".join(f"{part:02d}" for part in (whole // 3600, whole // 60 % 60, whole % 60))


def format_size(size: float) -> str:
    """In the largest of the binary units that leaves at least one."""
    power = 0 if size < 1 else min(len(UNITS) - 1, int(math.log(size, 1024) + 1e-12))
    return f"{size / 1024**power:.1f} {UNITS[power]}"


def _files(spark: SparkSession, path: str, glob: str) -> list:
    """Hadoop's status of the files of a folder, by name; none where the folder is missing."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}")
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(system.globStatus(pattern) or [], key=lambda f: f.getPath().getName())


def write_shards(df: DataFrame, path: str) -> tuple[int, int]:
    """Cleaned articles in files of at most 50,000 rows; how many files and bytes.

    Tasks write to a folder of their own, then the driver gives the files their names, which go on
    from those that are there. Only names pass through the driver; a run that is lost leaves the
    shards as they were.
    """
    spark = df.sparkSession
    fresh = f"{path}/_new-{uuid.uuid4().hex}"
    df.select("title", "text").write.option("maxRecordsPerFile", SHARD_ROWS).option("compression", "snappy").parquet(fresh)
    known = [int(f.getPath().getName()[len("wiki_shard_") : -len(".parquet")]) for f in _files(spark, path, SHARD_GLOB)]
    first = max(known, default=-1) + 1
    written = _files(spark, fresh, "part-*")
    hadoop, system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, None
    for k, f in enumerate(written, first):
        system = f.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.rename(f.getPath(), hadoop(f"{path}/{SHARD_NAME % k}"))
    if system:
        system.delete(hadoop(fresh), True)
    return len(written), sum(f.getLen() for f in written)


def read_shards(spark: SparkSession, path: str, glob: str = SHARD_GLOB) -> DataFrame:
    """All shards of a folder; an error if there are none."""
    if not _files(spark, path, glob):
        raise FileNotFoundError(f"no {glob} in {path}")
    return spark.read.option("pathGlobFilter", glob).parquet(path)


def has_shards(spark: SparkSession, path: str) -> bool:
    return bool(_files(spark, path, SHARD_GLOB))


def done_titles(spark: SparkSession, path: str) -> DataFrame:
    """The resume index: titles of shards that are written already. Titles can't collide as hashes can."""
    return read_shards(spark, path).select("title").distinct()


def write_table(df: DataFrame, path: str) -> None:
    """A statistics table or a rewritten corpus."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_rewritten(df: DataFrame, path: str) -> None:
    """A rewritten corpus, in a folder for each file that its articles came from (column ``file``)."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("file").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The labelled dataset as ``write_dataset`` leaves it."""
    return spark.read.schema(DATASET).parquet(path)


def write_dataset(df: DataFrame, path: str, csv: str | None = None) -> None:
    """The labelled dataset as Parquet and, if asked for, CSV with arrays as JSON."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        rows = df.select(*[F.to_json(c).alias(c) if c in _JSON else F.col(c) for c in df.columns])
        rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(csv)


def read_dataset_csv(spark: SparkSession, path: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(DATASET).fields}
    rows = read_csv(spark, path, "text string, input string, attention_mask string, offset_mapping string, output string")
    return rows.select("text", *[F.from_json(c, kinds[c]).alias(c) for c in _JSON])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose values may hold line ends and doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
