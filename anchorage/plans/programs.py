"""Whole runs: a dump to shards, and shards to statistics, lists and the rewritten corpus."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import links, match, rewrite
from ..sources import dump

log = logging.getLogger(__name__)


def extract(spark: SparkSession, source: str, target: str, limit: int | None = None, partitions: int | None = None) -> dict:
    """Cleans a dump's articles into shards; titles that shards hold already are left out.

    Returns the counters: pages, empty, redirects, already_done, to_clean, cleaned, errors,
    shards, bytes, seconds, pages_per_second. The dump is read once for the counters and once for
    the articles, which are cleaned once and kept on disk while they are counted and written.
    """
    start = time.monotonic()
    pages = dump.read_dump(spark, source, partitions)
    done = dump.done_titles(spark, target) if dump.has_shards(spark, target) else None
    out = dump.counters(pages, done).first().asDict()
    rows = dump.cleaned(dump.articles(pages, done, limit)).persist()
    try:
        out["shards"], out["bytes"] = dump.write_shards(rows.where("error is null"), target) if out["to_clean"] else (0, 0)
        sums = rows.agg(F.count_if(F.col("error").isNull()).alias("cleaned"), F.count_if(F.col("error").isNotNull()).alias("errors")).first()
        dump.log_errors(rows.where("error is not null").select("title", "error"))
    finally:
        rows.unpersist()
    out |= sums.asDict() | {"seconds": time.monotonic() - start}
    out["pages_per_second"] = out["pages"] / out["seconds"]
    log.info("%d pages, %d cleaned, %d errors, %d shards, %s, %s", out["pages"], out["cleaned"], out["errors"], out["shards"], dump.format_size(out["bytes"]), dump.format_duration(out["seconds"]))
    return out


def build(
    spark: SparkSession,
    input_dir: str,
    work_dir: str,
    out_dir: str,
    glob: str = dump.SHARD_GLOB,
    normalize_quotes: bool = False,
    min_anchor_len: int = 2,
    min_total: int = 10,
    min_link_for_plain_count: int = 10,
    whitelist_p: float = 0.95,
    whitelist_min_total: int = 50,
    whitelist_target_share: float = 0.98,
    blacklist_p: float = 0.05,
    ratio_threshold: float = 0.03,
) -> dict[str, DataFrame]:
    """Statistics, both lists and the rewritten corpus, each written once and read again.

    ``work_dir`` gets link_counts, anchor_targets, surface_stats, blacklist and whitelist;
    ``out_dir`` the articles, in a folder for each shard that they came from.
    """

    def kept(name: str, df: DataFrame) -> DataFrame:
        dump.write_table(df, f"{work_dir}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work_dir}/{name}")

    corpus = dump.read_shards(spark, input_dir, glob)
    rows = links.surface_links(links.parsed_links(corpus, quotes=normalize_quotes), normalize_quotes)
    pairs = links.anchor_target_counts(rows.where((F.length("anchor") >= min_anchor_len) & t.has_word_char(F.col("anchor"))), None, True)
    pairs = kept("anchor_targets", pairs)  # both statistics of links follow from it
    counts = kept("link_counts", pairs.groupBy("anchor").agg(F.sum("pair_count").alias("freq_link")))
    often = links.candidates(counts, min_link_for_plain_count)
    plain = match.plain_counts(corpus, often, quotes=normalize_quotes)
    stats = kept("surface_stats", links.surface_stats(counts, plain, min_total))
    black = kept("blacklist", links.blacklist(stats, blacklist_p))
    top = links.top_targets(pairs.where("target <> ''").join(links.candidates(counts, whitelist_min_total).select("anchor"), "anchor", "left_semi"))
    white = kept("whitelist", links.whitelist(stats, top, whitelist_p, whitelist_min_total, whitelist_target_share))
    named = corpus.select("title", "text", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet\z", "").alias("file"))
    articles = rewrite.rewritten(named, black, white, threshold=ratio_threshold, quotes=normalize_quotes, keep=("title", "file"))
    dump.write_rewritten(articles, out_dir)
    return {"link_counts": counts, "anchor_targets": pairs, "surface_stats": stats, "blacklist": black, "whitelist": white, "articles": spark.read.parquet(out_dir)}


def main(arguments: list[str] | None = None) -> None:
    """``python -m anchorage.plans.programs extract DUMP SHARDS`` or ``build SHARDS WORK OUT``, with the parameters above."""
    parser = argparse.ArgumentParser(prog="anchorage")
    runs = parser.add_subparsers(dest="run", required=True)
    one = runs.add_parser("extract")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("--limit", type=int)
    one.add_argument("--partitions", type=int)
    two = runs.add_parser("build")
    for name in ("input_dir", "work_dir", "out_dir"):
        two.add_argument(name)
    for name, value in zip(build.__code__.co_varnames[4:], build.__defaults__, strict=False):
        if value is False:
            two.add_argument(f"--{name}", action="store_true")
        else:
            two.add_argument(f"--{name}", type=type(value), default=value)
    given = vars(parser.parse_args(arguments))
    run = extract if given.pop("run") == "extract" else build
    run(SparkSession.builder.appName("anchorage").getOrCreate(), **given)


if __name__ == "__main__":
    main()
