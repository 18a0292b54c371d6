"""Link extraction and the statistics of surface forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t


def parsed_links(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), quotes: bool = False, compose: Callable[[Column], Column] = t.nfc) -> DataFrame:
    """One row a link to an article: ``*keep, target, anchor`` as written in the normalised text."""
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(*keep, t.norm_text(F.col(text), quotes, compose).alias("_text"))
    rows = rows.select(*keep, F.explode(t.link_inners(F.col("_text"))).alias("_inner")).select(*keep, t.parse_inner(F.col("_inner")).alias("_link"))
    return rows.where(t.is_content_target(F.col("_link.target"))).select(*keep, "_link.target", "_link.anchor")


def surface_links(links: DataFrame, quotes: bool = False) -> DataFrame:
    """Links with both sides in the form that they are counted in."""
    return links.withColumns({"anchor": t.norm_surface(F.col("anchor"), quotes), "target": t.norm_surface(F.col("target"), quotes)})


def link_counts(links: DataFrame, min_anchor_len: int = 2) -> DataFrame:
    """``anchor, freq_link`` over surface_links; short anchors and those without letter or digit are out."""
    a = F.col("anchor")
    return links.where((F.length(a) >= min_anchor_len) & t.has_word_char(a)).groupBy("anchor").agg(F.count("*").alias("freq_link"))


def candidates(counts: DataFrame, at_least: int) -> DataFrame:
    return counts.where(F.col("freq_link") >= at_least)


def anchor_target_counts(links: DataFrame, anchors: DataFrame | None = None, empty: bool = False) -> DataFrame:
    """``anchor, target, pair_count``, of the given anchors only; empty targets only if asked for."""
    rows = links if empty else links.where(F.col("target") != "")
    if anchors is not None:
        rows = rows.join(anchors.select("anchor"), "anchor", "left_semi")
    return rows.groupBy("anchor", "target").agg(F.count("*").alias("pair_count"))


def target_shares(pairs: DataFrame) -> DataFrame:
    """Each pair with its anchor's total and its rank among the anchor's targets."""
    w = W.partitionBy("anchor")
    first = w.orderBy(F.col("pair_count").desc(), "target")
    return pairs.withColumns({"total_pairs": F.sum("pair_count").over(w), "rank": F.row_number().over(first)})


def top_targets(pairs: DataFrame) -> DataFrame:
    """``anchor, target, target_share``: the commonest target; of equal ones the first by name.

    One aggregation with partial sums instead of a window: an anchor's pairs never meet in a sort.
    """
    best = F.min_by("target", F.struct(-F.col("pair_count"), "target")).alias("target")
    rows = pairs.groupBy("anchor").agg(best, F.max("pair_count").alias("top"), F.sum("pair_count").alias("pairs"))
    return rows.select("anchor", "target", (F.col("top") / F.col("pairs")).alias("target_share"))


def anchor_statistics(links: DataFrame, at_least: int, min_anchor_len: int = 2) -> DataFrame:
    """``anchor, freq_link, target, target_share``: ``link_counts`` and, for candidates, ``top_targets``.

    Both come from the pairs' counts, so the links are read and shuffled once.
    """
    a, known = F.col("anchor"), F.col("target") != ""
    pairs = links.where((F.length(a) >= min_anchor_len) & t.has_word_char(a)).groupBy("anchor", "target").agg(F.count("*").alias("pair_count"))
    best = F.min(F.when(known, F.struct((-F.col("pair_count")).alias("n"), "target")))
    rows = pairs.groupBy("anchor").agg(F.sum("pair_count").alias("freq_link"), best.alias("best"), F.sum(F.when(known, F.col("pair_count"))).alias("pairs"))
    often = F.col("freq_link") >= at_least
    return rows.select("anchor", "freq_link", F.when(often, F.col("best.target")).alias("target"), F.when(often, -F.col("best.n") / F.col("pairs")).alias("target_share"))


def surface_stats(counts: DataFrame, plain: DataFrame, min_total: int = 10) -> DataFrame:
    """``anchor, freq_link, freq_text, total, p_link``; anchors that were never looked for count 0."""
    rows = counts.join(plain, "anchor", "left").withColumn("freq_text", F.coalesce("freq_text", F.lit(0)).cast("bigint"))
    total = (F.col("freq_link") + F.col("freq_text")).alias("total")
    rows = rows.select("anchor", "freq_link", "freq_text", total).where(F.col("total") >= min_total)
    return rows.withColumn("p_link", F.col("freq_link") / F.col("total"))


def blacklist(stats: DataFrame, p: float = 0.05) -> DataFrame:
    return stats.where(F.col("p_link") <= p)


def whitelist(stats: DataFrame, top: DataFrame, p: float = 0.95, min_total: int = 50, target_share: float = 0.98) -> DataFrame:
    """Anchors that are nearly always linked, nearly always to one target."""
    rows = stats.where((F.col("p_link") >= p) & (F.col("total") >= min_total)).join(top, "anchor", "left")
    rows = rows.where(F.col("target").isNotNull() & (F.col("target_share") >= target_share))
    return rows.select("anchor", "target", "freq_link", "freq_text", "total", "p_link", "target_share")
