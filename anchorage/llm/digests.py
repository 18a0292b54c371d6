"""Document fingerprints: quartile bucket digests.

Byte triplets from a window of five bytes are hashed into 256 buckets; a fingerprint holds the
length on a log scale, and for each bucket the quartile of its count. Two fingerprints differ by
a bounded score, which ``likeness`` maps to 0 .. 1.

Hex layout: two digits of length code, two of quartile ratios, 128 of two-bit bucket codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, documents, without

BUCKETS = 256
#: Offsets of a triplet's bytes behind the newest byte of the window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: A difference of three quartiles counts so much; a step of the length code and of a ratio code too.
FAR, LENGTH_STEP, RATIO_STEP = 6, 12, 2
#: What unrelated codes of equal quarters differ by on average: 16 pairs of codes, 10 of distance 1
#: or 2 that sum to 14, and 2 of distance 3.
UNRELATED = BUCKETS * (6 * 1 + 4 * 2 + 2 * FAR) / 16
BLOCK = 1 << 20
#: Bytes of text in a range of documents, on average.
PART = 32 << 20

_pairs = np.arange(1 << 16, dtype=np.uint32)
_pairs = ((_pairs * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.uint16)
_thirds = np.array([((i * 0x85EBCA6B + 0x5BD1E995) >> 7) & 0xFFFF for i in range(256)], np.uint16)


def counts(data: bytes) -> np.ndarray:
    """Triplet counts by bucket; in blocks, so memory stays bounded."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 4), BLOCK):
        b = np.frombuffer(data[at : at + BLOCK + 4], np.uint8)
        n = len(b) - 4
        wide = b.astype(np.uint16)
        shifted = [wide[4 - k : 4 - k + n] for k in range(5)]
        high = {1: shifted[0] << 8 | shifted[1], 2: shifted[0] << 8 | shifted[2], 3: shifted[0] << 8 | shifted[3]}
        hashed = {k: _pairs[v] for k, v in high.items()}
        last = {k: _thirds[b[4 - k : 4 - k + n]] for k in (2, 3, 4)}
        for salt, (_, y, z) in enumerate(TRIPLETS, 1):
            mixed = (hashed[y] ^ last[z]) * np.uint16((2 * salt * 0x2F1B + 1) & 0xFFFF)
            out += np.bincount(mixed >> 8, minlength=BUCKETS)
    return out


def fingerprint(data: bytes) -> str:
    """The digest of a whole text's bytes. Texts under five bytes differ by length only."""
    c = counts(data)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = (codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]).astype(np.uint8)
    length = min(255, round(8 * math.log2(len(data) + 1)))
    r1, r2 = (int(q1 * 16 // q3) % 16, int(q2 * 16 // q3) % 16) if q3 else (0, 0)
    return f"{length:02x}{r1:x}{r2:x}{packed.tobytes().hex()}"


_distance = np.array([[abs((x >> s & 3) - (y >> s & 3)) for s in (0, 2, 4, 6)] for x in range(256) for y in range(256)])
_distance = np.where(_distance == 3, FAR, _distance).sum(axis=1).astype(np.int16).reshape(256, 256)


def difference(a: str, b: str) -> int:
    """0 for equal fingerprints; at most FAR a bucket plus the bounded length and ratio parts."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    body = int(_distance[np.frombuffer(x[2:], np.uint8), np.frombuffer(y[2:], np.uint8)].sum())
    length = max(0, abs(x[0] - y[0]) - 1) + (x[0] != y[0]) / LENGTH_STEP
    ratios = min(abs((x[1] >> 4) - (y[1] >> 4)), 8) + min(abs((x[1] & 15) - (y[1] & 15)), 8)
    return body + round(min(length, 8) * LENGTH_STEP) + ratios * RATIO_STEP


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 from the difference that unrelated ones have on average."""
    return max(0.0, 1 - difference(a, b) / UNRELATED)


def fingerprints(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """df with each whole text's fingerprint; null counts as empty, repeated rows get equal ones, an
    empty table gives no rows, and a column of df named as the result gives way to it."""
    df = without(df, to)
    at, names = df.columns.index(text), [*df.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(t.as_py() or b"") for t in b.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{to}` string")


def edited(text: str, following: str) -> str:
    """The text whose last half (rounded down) gave way to as many first code points of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a part, in order, compared with the next one. The last one's line is open; it and
    the first one come with their texts, the first one's line as ``first``."""
    out: list[tuple] = []
    held = None  # (part, id, text, fingerprint)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * len(_SCHEMA)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type if f.name != "doc_id" else id_type) for c, f in zip(cols, _SCHEMA, strict=True)], _SCHEMA.names)

    id_type = None
    for b in batches:
        id_type = b.schema.field("id").type
        for part, doc, t in zip(b.column("part").to_pylist(), b.column("id").to_pylist(), b.column("text"), strict=True):
            text = t.as_py() or ""
            print_ = fingerprint(text.encode("utf-8", "surrogatepass"))
            if held:
                out.append((*_line(held[1], held[2], held[3], text, print_), held[0], None, None))
            else:
                out.append((None, None, None, print_, None, None, None, part, text, True))
            held = (part, doc, text, print_)
            if len(out) >= 1000:
                yield flush()
    if held:
        out.append((held[1], None, None, held[3], None, None, None, held[0], held[2], False))
        yield flush()


def _line(doc, text: str, own: str, following: str, its: str) -> tuple:
    """A document's result, given the next one and both fingerprints."""
    new = edited(text, following).encode("utf-8", "surrogatepass")
    print_ = fingerprint(new)
    return doc, len(text), hashlib.sha256(new).hexdigest(), own, print_, likeness(own, print_), likeness(own, its)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open lines with the first row of the part that follows."""
    for b in batches:
        out = [_line(*row) for row in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")], strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [b.schema.field("doc_id").type, *[f.type for f in _SCHEMA][1:7]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], _SCHEMA.names[:7])


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("text", pa.string()), ("first", pa.bool_()),
])
_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Order: id, then a hash of the text, null ids last; rows alike in both are next to each other,
    those of many tasks too. Documents move once, by ranges of that order of about PART bytes;
    each row is compared with the next one of its range, and only the first and last row of each
    range wait for the range that follows, the very last for the very first. Null text is empty;
    very long texts are whole; a lone document is its own next one. Other columns than the two
    are not read. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    if not parts:
        size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PART))
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    order = [F.col("id").asc_nulls_last(), F.col("tie").asc()]
    # The place that a row was read at parts equal rows.
    dealt = rows.repartitionByRange(parts, *order, F.spark_partition_id()).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["id"]
    lines = scratch.save(dealt.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(_compared, f"doc_id {kind}, {_RESULT}, part int, text string, first boolean"))
    names = ["doc_id", *[c.split(" ")[0] for c in _RESULT.split(", ")]]
    ends = lines.where("first is not null")
    found = [r.part for r in ends.where("first").select("part").orderBy("part").collect()]  # one number a range
    follows = spark.createDataFrame([(p, found[(k + 1) % len(found)]) for k, p in enumerate(found)], "part int, next int")
    lead = ends.where("first").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = ends.where("not first").join(follows, "part").join(lead, "next").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    closed = last.mapInArrow(_closed, f"doc_id {kind}, {_RESULT}")
    return lines.where("first is null").select(*names).unionByName(closed).withColumnRenamed("doc_id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(documents(spark, sf_dir))
