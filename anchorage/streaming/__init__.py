"""Incremental extraction: cleans shards of raw pages as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.dump import articles, cleaned


def clean_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files of ``page_id, title, text`` as they land, writes ``title, text``, then ends.

    Stateless, so it needs no watermark; the checkpoint makes each file count once.
    """
    pages = spark.readStream.schema("page_id bigint, title string, text string").parquet(source)
    rows = cleaned(articles(pages)).where("error is null").select("title", "text")
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
