"""One query for each operator or stage. Pages become markup by their anchors; documents by a suffix rule."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import annotate, dataset, links, markup, match, rewrite
from ..sources import dump

#: Thresholds for the small test tables; the operators' defaults are those for a large corpus.
MIN_LINKS, MIN_TOTAL, BLACK_P, WHITE_P, WHITE_TOTAL, WHITE_SHARE = 2, 3, 0.05, 0.1, 3, 0.5
THRESHOLD = 0.1


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, text``: HTML with its anchors as inline links."""
    html = spark.read.parquet(f"{d}/pages.parquet")
    return html.select("page_id", F.regexp_replace("html", '<a href="/([^"]*)">([^<]*)</a>', "[[$1|$2]]").alias("text"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, text``: words of some endings are links, line ends are paragraph ends."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    linked = F.regexp_replace("text", "[a-z]*(?:tion|ung|eau|ción)", "[[$0]]")
    return docs.select("doc_id", F.regexp_replace(linked, "\n", "\n\n").alias("text"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return links.surface_links(links.parsed_links(pages(spark, d)))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return links.parsed_links(pages(spark, d), keep=("page_id",))


def link_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("page_id", F.explode(t.link_spans(F.col("text"))).alias("s"))
    return rows.select("page_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.inner").alias("inner_text"))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.link_counts(_links(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _links(spark, d)
    return links.anchor_target_counts(rows, links.candidates(links.link_counts(rows), MIN_LINKS))


def anchor_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.target_shares(_pairs(spark, d))


def top_target(spark: SparkSession, d: str) -> DataFrame:
    return links.top_targets(_pairs(spark, d))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    return match.plain_counts(pages(spark, d), links.candidates(link_counts(spark, d), MIN_LINKS))


def plain_counts(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d)


def plain_counts_join(spark: SparkSession, d: str) -> DataFrame:
    patterns = links.candidates(link_counts(spark, d), MIN_LINKS)
    return match.plain_counts_by_join(spark.read.parquet(f"{d}/documents.parquet"), patterns)


def _statistics(spark: SparkSession, d: str, anchors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The statistics of surfaces and the top targets, both from one table of anchors."""
    if anchors is None:
        anchors = links.anchor_statistics(_links(spark, d), MIN_LINKS)
    plain = match.plain_counts(pages(spark, d), links.candidates(anchors, MIN_LINKS))
    top = anchors.where("target is not null").select("anchor", "target", "target_share")
    return links.surface_stats(anchors.select("anchor", "freq_link"), plain, MIN_TOTAL), top


@contextlib.contextmanager
def _kept_statistics(spark: SparkSession, d: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The same, kept while lists are read from them several times."""
    anchors = links.anchor_statistics(_links(spark, d), MIN_LINKS).persist()
    stats, top = _statistics(spark, d, anchors)
    stats.persist()
    try:
        yield stats, top
    finally:
        stats.unpersist()
        anchors.unpersist()


def _whitelist(stats: DataFrame, top: DataFrame) -> DataFrame:
    return links.whitelist(stats, top, WHITE_P, WHITE_TOTAL, WHITE_SHARE)


def surface_stats(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d)[0]


def blacklist(spark: SparkSession, d: str) -> DataFrame:
    return links.blacklist(surface_stats(spark, d), BLACK_P)


def whitelist(spark: SparkSession, d: str) -> DataFrame:
    return _whitelist(*_statistics(spark, d))


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.norm_text(F.col("text"), True).alias("text"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.count_words(F.col("text")).alias("words"))


def link_ratio(spark: SparkSession, d: str) -> DataFrame:
    w = t.link_words(F.col("text"))
    return articles(spark, d).select("doc_id", w.alias("w"), t.link_ratio(F.col("text")).alias("link_ratio")).select("doc_id", "w.linked", "w.total", "link_ratio")


def paragraph_filter(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.filtered(articles(spark, d), threshold=THRESHOLD, keep=("doc_id",))


def strip_links(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", t.strip_links(F.col("text")).alias("text"))


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where(dataset.well_formed(F.col("text"))).select("page_id", dataset.strip_markup(F.col("text")).alias("raw"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).where(dataset.well_formed(F.col("text"))).select("page_id", F.explode(dataset.segments(F.col("text"))).alias("s"))
    return rows.select("page_id", F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"), F.col("s.text").alias("seg_text"), F.col("s.in_link").alias("in_link"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return dataset.labelled(pages(spark, d), max_length=None, keep=("page_id",))


def bio_labels(spark: SparkSession, d: str) -> DataFrame:
    zipped = F.arrays_zip(F.col("offset_mapping").alias("o"), F.col("output").alias("l"))
    rows = _labels(spark, d).select("page_id", F.posexplode(zipped).alias("pos", "x")).where("x.l <> -100")
    return rows.select("page_id", "pos", F.col("x.o.start").alias("tok_start"), F.col("x.o.end").alias("tok_end"), F.col("x.l").alias("label"))


def padded_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Each array as one string."""
    listed = lambda c: F.array_join(c.cast("array<string>"), ",")
    rows = dataset.labelled(pages(spark, d), keep=("page_id",))
    names = {"input": "input", "attention_mask": "attention_mask", "offset_mapping.start": "starts", "offset_mapping.end": "ends", "output": "output"}
    return rows.select("page_id", *[listed(F.col(c)).alias(n) for c, n in names.items()])


def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return dataset.label_histogram(_labels(spark, d)).withColumnRenamed("count", "n")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return dataset.class_weights(dataset.label_histogram(_labels(spark, d))).select("label", F.col("count").alias("n"), "weight")


def smoothing(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).select("page_id", F.posexplode(annotate.smoothed(F.col("output"))).alias("pos", "tag"))
    return rows


def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels(spark, d).withColumn("tags", annotate.smoothed(F.col("output")))
    return annotate.token_accuracy(rows, "tags", "output")


def token_argmax(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", annotate.argmax(F.col("embedding")).alias("best"))


def mean_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    z = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    rows = rows.select("vec_id", F.array(z).alias("logits"), F.array((F.col("vec_id") % 3).cast("int")).alias("gold"))
    return annotate.mean_loss(rows, "logits", "gold", "vec_id", [1.0, 22.0, 4.0])


def unlink_blacklist(spark: SparkSession, d: str) -> DataFrame:
    with _kept_statistics(spark, d) as (stats, _):
        unlink = rewrite.unlink(links.blacklist(stats, 0.3))
    return pages(spark, d).select("page_id", unlink(F.col("text")).alias("text"))


def autolink_whitelist(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    with _kept_statistics(spark, d) as known:
        autolink = rewrite.autolink(_whitelist(*known))
    return docs.select("doc_id", autolink(F.col("text")).alias("text"))


def rewritten_corpus(spark: SparkSession, d: str) -> DataFrame:
    with _kept_statistics(spark, d) as (stats, top):
        return rewrite.rewritten(pages(spark, d), links.blacklist(stats, BLACK_P), _whitelist(stats, top), threshold=0.001, keep=("page_id",))


def annotate_html(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    with _kept_statistics(spark, d) as known:
        return annotate.annotate(docs, _whitelist(*known)).select("doc_id", "html")


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return dataset.split(docs, "doc_id", seed=None)


def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return dataset.split(docs, "doc_id").groupBy("part").agg(F.count("*").alias("n"))


def squeeze(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.squeeze(F.col("html")).alias("text"))


def clean_markup(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).withColumn("title", F.concat(F.lit("Page "), "page_id"))
    return markup.cleaned(rows).select("page_id", "text", "error")


def _as_dump(spark: SparkSession, d: str) -> DataFrame:
    """Documents as dump pages; some sources play the part of redirects."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.when(F.col("source") == "src3", F.concat(F.lit("#Redirection "), "text")).when(F.col("source") == "src5", "").otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("T"), "doc_id").alias("title"), text.alias("text"))


def _done(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit("T"), "doc_id").alias("title"))


def redirect_filter(spark: SparkSession, d: str) -> DataFrame:
    return dump.articles(_as_dump(spark, d)).select("page_id", "title")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return dump.articles(_as_dump(spark, d), _done(spark, d)).select("page_id", "title")


def extraction_counters(spark: SparkSession, d: str) -> DataFrame:
    return dump.counters(_as_dump(spark, d), _done(spark, d))


def url_quote(spark: SparkSession, d: str) -> DataFrame:
    return link_extract(spark, d).select("page_id", "target", t.url_quote(F.col("target")).alias("quoted"))


_ALL = (
    link_extract, link_spans, link_counts, anchor_targets, top_target, plain_counts, plain_counts_join, surface_stats, blacklist, whitelist,
    norm_text, word_counts, link_ratio, paragraph_filter, strip_links, strip_markup, segments, bio_labels, padded_dataset, label_histogram,
    class_weights, smoothing, token_accuracy, token_argmax, mean_loss, unlink_blacklist, autolink_whitelist, rewritten_corpus, annotate_html,
    split_sizes, seeded_split, squeeze, clean_markup, redirect_filter, resume_anti, extraction_counters, url_quote,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
