"""Sharding by a Feistel permutation with cycle walking, in native expressions.

Rows get a global number by their order; a keyed permutation of 0 .. n-1 gives each its place,
``shard = place mod shards`` and ``slot = place div shards``. Anyone who knows n, the key and a
row's number can compute both, and the inverse. The law is ``rows``: shard counts differ by one
at most. Copies of a text are not kept together: under this law a large group can't be.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import Scratch, documents

ROUNDS = 8
SHARDS = 40
#: Walks that are written out; the rest of a cycle, next to never needed, is a fold.
STEPS = 3


def sides(n: int) -> tuple[int, int]:
    """The smallest rectangle a x b of about equal sides with a * b >= n; a * b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole division of longs; ``/`` would go through doubles."""
    return F.call_function("div", x.cast("bigint"), F.lit(by).cast("bigint"))


def _once(x: Column, a: int, b: int, key: int, rounds: int) -> Column:
    """One pass of the network over 0 .. a*b-1: halves are added to in turn, mod a and mod b."""

    def turn(s: Column, r: Column) -> Column:
        left = F.pmod(s.l + F.pmod(F.xxhash64(F.lit(key), r, F.lit(0), s.r), F.lit(a)), F.lit(a))
        return F.struct(left.cast("bigint").alias("l"), s.r.alias("r"))

    def other(s: Column, r: Column) -> Column:
        right = F.pmod(s.r + F.pmod(F.xxhash64(F.lit(key), r, F.lit(1), s.l), F.lit(b)), F.lit(b))
        return F.struct(s.l.alias("l"), right.cast("bigint").alias("r"))

    start = F.struct(_div(x, b).alias("l"), (x % b).cast("bigint").alias("r"))
    state = F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, lambda s, i: F.when(i % 2 == 0, turn(s, i)).otherwise(other(s, i)))
    return F.transform(F.array(state), lambda s: s.l * F.lit(b).cast("bigint") + s.r)[0]


def permuted(x: Column, n: int, key: int = 0, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. n-1. Values that fall outside go through the network again.

    At most ``a*b - n < a`` values lie outside, so a walk of that many further passes always ends
    inside; the fold is only evaluated for a row that ``STEPS`` passes have left outside.
    """
    a, b = sides(n)
    outside = a * b - n

    def again(v: Column) -> Column:
        return F.when(v < n, v).otherwise(_once(v, a, b, key, rounds))

    def bound(v: Column, f) -> Column:  # evaluates v once
        return F.transform(F.array(v), f)[0]

    out = _once(x, a, b, key, rounds)
    for _ in range(min(STEPS, outside)):
        out = bound(out, again)
    if outside > STEPS:
        out = bound(out, lambda v: F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(outside)), v, lambda s, _: again(s))))
    return out


def numbered(df: DataFrame, order: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """df with ``number``, its global rank by the columns of order, and the count of rows.

    Rows are dealt by range, the last range key being the place they were read at, so that equal
    rows part too; within a partition the low bits of monotonically_increasing_id count rows.
    One row a partition is broadcast: a bound that is set by the cluster, not by the data.
    """
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order], F.spark_partition_id()).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    placed = scratch.save(dealt.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("rows"))  # one row a partition
    before = F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = scratch.save(sizes.withColumn("start", F.coalesce(before, F.lit(0))))
    total = starts.agg(F.sum("rows")).first()[0] or 0
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return out.withColumn("number", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "start", "rows"), total


def shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", count: int = SHARDS, key: int = 0) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, number``.

    Order: id (null last), then CRC, then size; rows alike in all three are interchangeable, so
    the result is reproducible. Null text has no bytes; very long texts are read where they lie
    and don't move. Other columns than the two are not read. An empty table gives no rows.
    """
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    thin = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(bytes_) + 16).cast("bigint").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    rows, n = numbered(thin, ["doc_id", "text_crc32", "size"], Scratch(df.sparkSession))
    place = permuted(F.col("number"), n, key) if n else F.col("number")
    rows = rows.withColumn("place", place.cast("bigint"))
    return rows.select(
        F.col("doc_id").alias(doc_id),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % count).cast("int").alias("shard"),
        _div(F.col("place"), count).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))
