"""Mixing sources to target weights by entropy balancing, in native expressions.

Document rates r minimise the entropy sum (r log r - r) under one token constraint a source,
``sum r * size = target``, and r <= 3. The convex dual has one variable a source; its solution
tilts rates exponentially, ``r = min(3, exp(lambda * size / mean))``. Newton steps, kept inside
a closed-form bracket, run for all sources at once on the histogram of sizes. Rates are rounded
to copies by each document's hash; the words a source then misses or has too many are settled by
copies of documents that a second hash picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import Scratch, documents

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BUCKETS = 1 << 16
TURNS, CLOSE = 60, 1e-10
SETTLING = 6
#: Rows of a repeated key that are numbered in one task.
SHARE = 10_000


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, target`` from ``source, source_size``: one row a source.

    Sources by code point, null last, take the weights in turn and share all words; what passes
    ``most`` times a source's size is shared again by weight. Closed form: with sources by cap a
    weight, the first k capped, the water level is (all - caps) / weights left; the first k whose
    next source stays below its cap is right.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("water", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def rate(lam: Column, size: Column, mean: Column, most: float = MOST) -> Column:
    return F.least(F.lit(float(most)), F.exp(lam * size / mean))


def _solve(hist: DataFrame, goals: DataFrame, most: float, scratch: Scratch, few: bool) -> DataFrame:
    """``source, lam``: safeguarded Newton on the dual, one distributed sum a step; few: whether a line a source may be broadcast.

    A source's line is part of the sum's key, so that it needs no second join: the driver's memory
    grows with the plans, threads and code of a call.
    """
    stats = hist.groupBy("sk").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"), F.min("size").alias("least"))
    ratio = F.col("target") / F.col("source_size")
    least = F.col("least") / F.col("mean")
    state = goals.join(stats, "sk").select(
        "sk",
        "mean",
        "target",
        # All rates are at most the ratio at the lower end and at least it at the upper end.
        F.when(ratio < 1, F.log(ratio) / least).otherwise(0.0).alias("lo"),
        F.when(ratio > 1, F.log(F.lit(float(most))) / least).otherwise(0.0).alias("hi"),
        F.lit(0.0).alias("lam"),
        F.lit(1e300).alias("off"),
    )
    state = scratch.save(state)
    for _ in range(TURNS):
        x = F.col("size") / F.col("mean")
        r = rate(F.col("lam"), F.col("size"), F.col("mean"), most)
        step = hist.join(F.broadcast(state) if few else state, "sk").groupBy("sk", "mean", "target", "lo", "hi", "lam").agg(
            F.sum(r * F.col("size") * F.col("docs")).alias("got"),
            F.sum(F.when(r < most, r * F.col("size") * x * F.col("docs")).otherwise(0.0)).alias("slope"),
        )
        step = step.withColumn("gap", F.col("got") - F.col("target"))
        lo = F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("gap") > 0, F.col("lam")).otherwise(F.col("hi"))
        step = step.select("sk", "mean", "target", lo.alias("lo"), hi.alias("hi"), "gap", "slope", F.col("lam").alias("was"))
        newton = F.col("was") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        # Newton's step where it stays inside the bracket, which every sum shrinks; else bisection.
        lam = F.when(F.abs(F.col("gap")) <= CLOSE * F.col("target"), F.col("was")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = scratch.save(step.select("sk", "mean", "target", "lo", "hi", lam.alias("lam"), (F.abs("gap") / F.col("target")).alias("off")))
        scratch.drop(state)
        state = new
        if new.where((F.col("off") > CLOSE) & (F.col("hi") - F.col("lo") > 1e-13 * (1 + F.abs("lam")))).isEmpty():
            break
    return state.select("sk", "lam", "mean")


def _small(df: DataFrame) -> bool:
    """Whether a table of one row a source may be broadcast: its size is checked."""
    return df.count() <= 20_000


def _bucket(turn: int, gap: Column, most: int) -> Column:
    """The hash bucket of a document that may change by a copy in this turn; else null."""
    able = (F.col("size") > 0) & (F.col("size") <= F.greatest(F.abs(gap) / (2 if turn < SETTLING // 2 else 1), F.lit(1.0))) & (F.abs(gap) >= 1)
    able = able & F.when(gap > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    return F.when(able, F.pmod(F.xxhash64(F.lit(turn), "key", "rank"), F.lit(BUCKETS)).cast("int"))


def _decided(rows: DataFrame, params: DataFrame, most: int, turns: int, few: bool) -> DataFrame:
    """Rows with ``rate`` and ``copies`` after so many turns of settling: a function of the row and
    its source's line in params, so any scan of the documents can repeat it without a shuffle."""
    out = rows.join(F.broadcast(params) if few else params, "sk")
    tilted = F.when(F.col("goal") >= most * F.col("source_size"), float(most)).otherwise(rate(F.col("lam"), F.col("size"), F.col("mean"), most))
    out = out.withColumn("rate", F.when(F.col("size") > 0, tilted).otherwise(0.0))
    unit = F.pmod(F.xxhash64(F.lit(11), "key", "rank"), F.lit(1 << 40)) / float(1 << 40)
    out = out.withColumn("copies", F.least(F.lit(most), F.floor(F.col("rate") + unit).cast("int")))
    for t in range(turns):
        gap = F.col("gaps")[t]
        moved = F.coalesce(_bucket(t, gap, most) < F.col("cuts")[t], F.lit(False))
        out = out.withColumn("copies", F.col("copies") + F.when(moved, F.when(gap > 0, 1).otherwise(-1)).otherwise(0))
    return out


def _settle(rows: DataFrame, params: DataFrame, most: int, scratch: Scratch, few: bool) -> DataFrame:
    """Adds to params what each turn of settling needs: a source's gap and the bucket to stop at.

    In a turn, documents of at most half the gap, later of at most the gap, lie in hash buckets;
    buckets are taken in order while their sum stays within the gap. What is left is less than
    the next bucket.
    """
    params = params.withColumns({"gaps": F.array().cast("array<double>"), "cuts": F.array().cast("array<int>")})
    params = scratch.save(params)
    for t in range(SETTLING):
        now = _decided(rows, params, most, t, few)
        gaps = now.groupBy("sk").agg((F.first("goal") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        gaps = scratch.save(gaps)
        now = now.join(F.broadcast(gaps) if few else gaps, "sk")
        sums = now.withColumn("bucket", _bucket(t, F.col("gap"), most)).where("bucket is not null").groupBy("sk", "bucket").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
        reach = F.sum("words").over(W.partitionBy("sk").orderBy("bucket"))
        cut = sums.withColumn("reach", reach).where(F.col("reach") > F.abs("gap")).groupBy("sk").agg(F.min("bucket").alias("cut"))
        new = params.join(gaps, "sk", "left").join(cut, "sk", "left")
        new = scratch.save(new.withColumns({"gaps": F.concat("gaps", F.array(F.coalesce("gap", F.lit(0.0)))), "cuts": F.concat("cuts", F.array(F.coalesce("cut", F.lit(BUCKETS))))}).drop("gap", "cut"))
        scratch.drop(params, gaps)
        params = new
    return params


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, copies, rate, source``.

    Null sources are one source, ranked last; null text has no words; a document without words
    gets no copies. Ids may be null or repeat; rows alike in id, text and source are numbered, so
    they share their copies and a rerun gives the same rows. Other columns than the three are not
    read. An empty table gives no rows.
    """
    rows, params, _, few = _planned(df, doc_id, text, source, weights, most)
    out = _decided(rows, params, most, SETTLING, few)
    return out.select(F.col("doc_id").alias(doc_id), "size", "source_size", F.col("goal").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", F.col("source").alias(source))


def _thin(df: DataFrame, doc_id: str, text: str, source: str, keep: list[str]) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    key = F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text), _source_key(F.col(source)))
    return df.select(*keep, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _source_key(F.col(source)).alias("sk"), key.alias("key"))


def _ranked(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with ``rank``: 0, and 0, 1, ... without gaps among the rows of a repeated key.

    Which of them gets which number doesn't matter, as they are alike. Keys with many rows are
    numbered in parts of SHARE rows or so, behind the sizes of the parts before.
    """
    if repeated.isEmpty():
        return rows.withColumn("rank", F.lit(0).cast("bigint"))
    alone = rows.join(repeated, "key", "left_anti").withColumn("rank", F.lit(0).cast("bigint"))
    many = rows.withColumn("at", F.monotonically_increasing_id()).join(repeated, "key")
    many = many.withColumn("part", F.pmod(F.xxhash64("at"), F.ceil(F.col("rows") / SHARE)).cast("int"))
    sizes = many.groupBy("key", "part").agg(F.count("*").alias("n"))  # a row a SHARE
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("key", "part").orderBy("at"))
    many = many.withColumn("within", within).join(sizes.select("key", "part", before.alias("before")), ["key", "part"])
    many = many.withColumn("rank", (F.col("before") + F.col("within") - 1).cast("bigint"))
    return alone.unionByName(many.drop("at", "rows", "part", "within", "before"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _planned(df: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], most: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """The thin rows, one line of parameters a source, keys that several rows have, and whether the sources are few."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_thin(df, doc_id, text, source, []))
    repeated = scratch.save(rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"))
    if not repeated.isEmpty():
        rows = scratch.save(_ranked(rows, repeated))
    else:
        rows = _ranked(rows, repeated)
    hist = scratch.save(rows.groupBy("source", "sk", "size").agg(F.count("*").alias("docs")))
    sources = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    goals = scratch.save(targets(sources, weights, most).withColumn("sk", _source_key(F.col("source"))))
    few = _small(goals)
    lam = _solve(hist.where("size > 0").drop("source"), goals.where("source_size > 0").drop("source"), float(most), scratch, few)
    params = goals.select("sk", "source_size", F.col("target").alias("goal")).join(lam, "sk", "left")
    return rows, _settle(rows, params, most, scratch, few), repeated, few


def mixed_documents(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df's rows as often as the mix takes them, with df's columns; a document without words once."""
    _, params, repeated, few = _planned(df, doc_id, text, source, weights, most)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    out = _decided(_ranked(_thin(df, doc_id, text, source, [row]), repeated), params, most, SETTLING, few)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
