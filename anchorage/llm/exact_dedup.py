"""Exact dedup by composable polynomial fingerprints.

A chunk ``b`` of n bytes has the digest ``(n, h, B**n)`` with ``h = sum (b_i + 1) * B**(n-1-i)``
mod ``2**31 - 1``, for two bases. Digests of neighbouring chunks combine by length-shifted
arithmetic, ``h(ab) = h(a) * B**len(b) + h(b)``, which is associative: chunks of a huge document
are hashed apart, in any tasks, and combined by native expressions. Texts of equal fingerprint
are compared as streams of chunks before they count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BLANK_BYTES, Scratch, bits_for, documents, in_bitmap, key_bitmap, tidy

MODULUS = (1 << 31) - 1
BASES = (1_000_003, 48_271_337)
CHUNK = 1 << 16
DIGEST = "struct<n:bigint,h1:bigint,s1:bigint,h2:bigint,s2:bigint>"
#: A text of more bytes is cut into parts of so many code points, which are hashed in any tasks.
HUGE, PART = 1 << 20, 1 << 18
#: A group with more rows or bytes than these, and than a thousandth of all, is salted.
HOT_ROWS, HOT_BYTES = 10_000, 256 << 20


def normalise(raw: bytes) -> bytes:
    """UTF-8 without white space: a blank's byte is never part of a longer character."""
    return raw.translate(None, BLANK_BYTES)


@lru_cache
def _powers(base: int, modulus: int) -> np.ndarray:
    """base ** (CHUNK - 1), ..., base ** 0."""
    out = np.ones(CHUNK + 1, np.uint64)
    done = 1
    while done <= CHUNK:  # doubling
        k = min(done, CHUNK + 1 - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += k
    return out[::-1]


def chunk_digest(chunk: bytes, modulus: int = MODULUS) -> dict:
    """The digest of at most CHUNK bytes."""
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    out = {"n": len(b)}
    for k, base in enumerate(BASES, 1):
        powers = _powers(base, modulus)
        out[f"h{k}"] = int(np.dot(b, powers[CHUNK + 1 - len(b) :]) % np.uint64(modulus))
        out[f"s{k}"] = int(powers[CHUNK - len(b)])
    return out


def digests(data: bytes, modulus: int = MODULUS) -> list[dict]:
    return [chunk_digest(data[i : i + CHUNK], modulus) for i in range(0, len(data), CHUNK)]


def combine(digest_array: Column, modulus: int = MODULUS) -> Column:
    """Folds an array of chunk digests, in order, into the digest of the whole; native."""
    zero = F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in (("n", 0), ("h1", 0), ("s1", 1), ("h2", 0), ("s2", 1))])

    def step(a: Column, b: Column) -> Column:
        return F.struct(
            (a.n + b.n).alias("n"),
            *[
                x
                for k in "12"
                for x in (
                    ((a[f"h{k}"] * b[f"s{k}"] + b[f"h{k}"]) % modulus).alias(f"h{k}"),
                    (a[f"s{k}"] * b[f"s{k}"] % modulus).alias(f"s{k}"),
                )
            ],
        )

    return F.aggregate(digest_array, zero, step)


def fingerprint_parts(parts: DataFrame, key: str, seq: str, part: str, modulus: int = MODULUS) -> DataFrame:
    """Fingerprints of documents that are stored as rows of parts: ``key, n, f1, f2``.

    Parts are hashed where they lie; only digests meet. Null parts count as empty.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [digests(normalise((x or "").encode("utf-8", "surrogatepass")), modulus) for x in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array(d, _DIGESTS)], ["key", "seq", "d"])

    kind = dict(parts.dtypes)
    rows = parts.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(part).alias("part"))
    rows = rows.mapInArrow(tidy(hashed), f"key {kind[key]}, seq {kind[seq]}, d array<{DIGEST}>")
    whole = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "d"))).alias("all"))
    whole = whole.select("key", combine(F.flatten(F.transform("all", lambda x: x.d)), modulus).alias("d"))
    return whole.select(F.col("key").alias(key), F.col("d.n").alias("n"), F.col("d.h1").alias("f1"), F.col("d.h2").alias("f2"))


def _cut(huge: DataFrame) -> DataFrame:
    """``rid, seq, part``: texts in parts that are dealt to all tasks."""
    count = F.ceil(F.length("text") / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("text"), i * PART + 1, F.lit(PART)))
    return huge.select("rid", F.posexplode(parts).alias("seq", "part")).repartition("rid", "seq")


_DIGESTS = pa.list_(pa.struct([(k, pa.int64()) for k in ("n", "h1", "s1", "h2", "s2")]))
_KEY = ["n", "f1", "f2"]


def _hashed(df: DataFrame, text: str, modulus: int, bitmap=None, want: bool | None = None, sha: bool = False) -> DataFrame:
    """df with ``n, f1, f2`` and, if asked for, ``text_sha256``.

    With a bitmap only rows whose fingerprint's bit is as wanted are returned. One whole text is
    in memory at a time beside its Arrow batch.
    """
    names = [f.name for f in df.schema]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            col = b.column(at)
            ds, shas = [], []
            for x in col.cast(pa.large_binary()) if len(col) else ():
                clean = normalise(x.as_py() or b"")
                ds.append(_fold(digests(clean, modulus), modulus))
                if sha:
                    shas.append(hashlib.sha256(clean).hexdigest())
            key = np.array(ds, np.int64).reshape(-1, 3)
            cols = list(b.columns) if want is not None or sha else []
            cols += [pa.array(key[:, k]) for k in range(3)] + ([pa.array(shas, pa.string())] if sha else [])
            out = pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(cols))])
            if bits is not None:
                out = out.filter(pa.array(in_bitmap(bits, _mixed(key)) == want))
            yield pa.RecordBatch.from_arrays(out.columns, fields)

    base = list(df.schema.fields) if want is not None or sha else []
    schema = T.StructType(base + [T.StructField(k, T.LongType()) for k in _KEY] + ([T.StructField("text_sha256", T.StringType())] if sha else []))
    fields = schema.names
    return (df if base else df.select(text)).mapInArrow(tidy(run), schema) if base else _only(df, text, modulus, schema)


def _only(df: DataFrame, text: str, modulus: int, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds = [_fold(digests(normalise(x.as_py() or b""), modulus), modulus) for x in b.column(0).cast(pa.large_binary())]
            key = np.array(ds, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(key[:, k]) for k in range(3)], _KEY)

    return df.select(text).mapInArrow(tidy(run), schema)


def _fold(ds: list[dict], modulus: int) -> tuple[int, int, int]:
    n, h1, h2 = 0, 0, 0
    for d in ds:
        n, h1, h2 = n + d["n"], (h1 * d["s1"] + d["h1"]) % modulus, (h2 * d["s2"] + d["h2"]) % modulus
    return n, h1, h2


def _mixed(key: np.ndarray) -> np.ndarray:
    """One long a fingerprint, as ``_mixed_column`` has it."""
    return key[:, 1] * (1 << 31) + key[:, 2] ^ key[:, 0]


def _mixed_column() -> Column:
    return (F.col("f1") * F.lit(1 << 31) + F.col("f2")).bitwiseXOR(F.col("n"))


def _chunks(text: str) -> Iterator[bytes]:
    """A text's normalised bytes, chunk after chunk, without a normalised copy of the whole."""
    rest = b""
    for i in range(0, len(text), CHUNK):
        rest += normalise(text[i : i + CHUNK].encode("utf-8", "surrogatepass"))
        while len(rest) >= CHUNK:
            yield rest[:CHUNK]
            rest = rest[CHUNK:]
    if rest:
        yield rest


def same_stream(a: str, b: str) -> bool:
    """Compares two texts without white space chunk by chunk, ending at the first difference."""
    x, y = _chunks(a), _chunks(b)
    while True:
        p, q = next(x, None), next(y, None)
        if p != q:
            return False
        if p is None:
            return True


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [same_stream(x.as_py() or "", y.as_py() or "") for x, y in zip(b.column("text"), b.column("rep_text"), strict=True)]
        keep = [n for n in b.schema.names if n not in ("text", "rep_text")]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(same, pa.bool_())], [*keep, "same"])


def _packed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, text, row``: df with its other columns, whatever their names, in one."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text], F.lit(None).cast("int").alias("_"))
    return df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), row.alias("row"))


def resolve_groups(df: DataFrame, modulus: int = MODULUS, sha: bool = True) -> tuple[DataFrame, DataFrame]:
    """Splits rows of ``id, text, row`` into (certainly single, decided), both with ``keep_id,
    group_size, kept`` and, with ``sha``, ``text_sha256``.

    Pass 1 counts fingerprints with partial aggregation and turns repeated ones into a bitmap of
    at most 16 MiB. Texts beyond HUGE bytes are cut, their parts hashed apart and combined. Rows
    whose bit is clear are single and never shuffled. The others, about as many as there are
    copies, meet their group's representative by a join that is salted for hot groups, and are
    compared chunk by chunk. Rows that differ from it (a collision) go through another turn
    among themselves. Equal texts: the row with most code points, then smallest id, stays; a null
    id comes last; of repeated rows one stays. Null text is an empty text. An empty table gives
    no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = df.agg(F.sum(size).alias("bytes"), F.count_if(size > HUGE).alias("huge")).first()
    keys = _hashed(df, "text", modulus)
    usual, huge = df, None
    if total.huge:
        usual = df.where(size <= HUGE)
        huge = scratch.save(df.where(size > HUGE).withColumn("rid", F.monotonically_increasing_id()))
        huge = huge.join(scratch.save(fingerprint_parts(_cut(huge), "rid", "seq", "part", modulus)), "rid").drop("rid")
        keys = _hashed(usual, "text", modulus).unionByName(huge.select(*_KEY))
    repeated = scratch.save(keys.groupBy(*_KEY).agg(F.count("*").alias("rows")).where("rows > 1"))
    bits = bits_for(repeated.count())
    bitmap = spark.sparkContext.broadcast(key_bitmap(repeated, _mixed_column(), bits).tobytes())

    single = _hashed(usual, "text", modulus, bitmap, False, sha)
    found = _hashed(usual, "text", modulus, bitmap, True, sha)
    if huge is not None:
        if sha:
            huge = huge.withColumn("text_sha256", F.sha2(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "").cast("binary"), 256))
        single = single.unionByName(huge.join(repeated, _KEY, "left_anti").select(*single.columns))
        found = found.unionByName(huge.join(repeated, _KEY, "left_semi").select(*found.columns))
    single = single.withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}).drop(*_KEY)

    found = scratch.save(found.withColumn("rid", F.monotonically_increasing_id()))
    hot_rows, hot_bytes = max(HOT_ROWS, found.count() // 1000), max(HOT_BYTES, (total.bytes or 0) // 1000)
    pending, decided = found.select("rid", "id", "text", *_KEY), []
    order = F.struct((-F.length(F.coalesce("text", F.lit("")))).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("rid").alias("d"))
    while True:
        reps = pending.groupBy(*_KEY).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.min(order).alias("best"), F.min_by("text", order).alias("rep_text"))
        salts = F.least(F.col("rows"), F.greatest(F.ceil(F.col("rows") / hot_rows), F.ceil(F.col("bytes") / hot_bytes))).cast("int")
        reps = scratch.save(reps.select(*_KEY, "rows", salts.alias("salts"), F.col("best.c").alias("rep_id"), F.col("best.d").alias("rep_rid"), "rep_text"))
        # At most 1000 groups can have more than a thousandth of the rows, and as many of the bytes: a proven bound.
        hot = reps.where("salts > 1").select(*_KEY, "salts")
        salted = pending.join(F.broadcast(hot), _KEY, "left").withColumn("salt", F.coalesce(F.pmod(F.hash("rid"), F.col("salts")), F.lit(0))).drop("salts")
        spread = reps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("salts"), F.lit(1)) - 1))).drop("salts")
        met = salted.join(spread, [*_KEY, "salt"]).select("rid", "rep_rid", "rep_id", "rows", "text", "rep_text")
        kind = dict(df.dtypes)["id"]
        met = scratch.save(met.mapInArrow(tidy(_compare), f"rid bigint, rep_rid bigint, rep_id {kind}, rows bigint, same boolean"))
        missed = met.where(~F.col("same"))
        if missed.isEmpty():
            decided.append(met.where("same"))
            break
        off = missed.groupBy("rep_rid").agg(F.count("*").alias("off"))
        decided.append(met.where("same").join(off, "rep_rid", "left").withColumn("rows", F.col("rows") - F.coalesce("off", F.lit(0))).drop("off"))
        pending = scratch.save(pending.join(missed.select("rid"), "rid", "left_semi"))
    verdict = decided[0].select("rid", "rep_rid", "rep_id", "rows")
    for d in decided[1:]:
        verdict = verdict.unionByName(d.select(*verdict.columns))
    multiple = found.drop(*_KEY).join(verdict, "rid").withColumns({"keep_id": F.col("rep_id"), "group_size": F.col("rows"), "kept": F.col("rid") == F.col("rep_rid")})
    return single, multiple.select(*single.columns)


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = MODULUS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``; see ``resolve_groups``.
    Other columns than the two are not read."""
    single, multiple = resolve_groups(df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), modulus)
    return single.unionByName(multiple).select(F.col("id").alias(doc_id), "keep_id", "group_size", "kept", "text_sha256")


def keep_first_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns, whatever their names."""
    single, multiple = resolve_groups(_packed(df, doc_id, text), sha=False)
    names = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns]
    return single.select(*names).unionByName(multiple.where("kept").select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
