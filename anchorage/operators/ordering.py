"""Global ranks without a sort in one task."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1 << 10
#: Parts that the rows of one frequent value are dealt into.
SALTS = 64
LARGEST = (1 << 63) - 1


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: a binary search."""
    if not bounds:
        return F.lit(0)
    known = F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= value, at + step).otherwise(at))


def bucketed(df: DataFrame, value: str, ties: Column | None = None) -> DataFrame:
    """df with ``_b``, the range of a long column that the row lies in, and ``_n, _before``: rows in it
    and in the ranges below. Nulls come first.

    Ranges lie between quantiles, so far-off values don't crowd the others into one range. A value
    that fills more than one has a range of its own, which ``ties``, a long, deals into SALTS parts.
    Quantiles are doubles: beyond 2^53 neighbouring values may share a range, undealt but in order.
    The sizes, at most some 40,000 rows whatever the table, are broadcast.
    """
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = df.agg(F.percentile_approx(F.col(value).cast("bigint"), shares, 10 * BUCKETS)).first()[0] or []
    often = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    bounds = sorted({*cuts, *(v + 1 for v in often if v < LARGEST)})
    rows = df.withColumn("_b", F.when(F.col(value).isNull(), -1).otherwise(_below(F.col(value).cast("bigint"), bounds)))
    if ties is not None:
        own = [-1, *(bisect_right(bounds, v) for v in often)]
        rows = rows.withColumn("_b", F.col("_b") * SALTS + F.when(F.col("_b").isin(own), F.pmod(ties, F.lit(SALTS)).cast("int")).otherwise(0))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    return rows.join(F.broadcast(sizes.withColumn("_before", F.coalesce(before, F.lit(0)))), "_b")


def ranked(df: DataFrame, value: str, to: str = "rank") -> DataFrame:
    """df with its rows' rank by a long column, from 0; each range is sorted by itself.

    Rows of equal value are in the order of a hash of all columns, so ranks agree from run to run;
    rows alike in all columns are interchangeable and stay in one range.
    """
    rows = bucketed(df.withColumn("_t", F.xxhash64(*df.columns)), value, F.col("_t"))
    return rows.withColumn(to, F.row_number().over(W.partitionBy("_b").orderBy(value, "_t")) + F.col("_before") - 1).drop("_b", "_n", "_before", "_t")
