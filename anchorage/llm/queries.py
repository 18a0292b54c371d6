"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import digests, exact_dedup, jaccard_join, licenses, mixing, pieces, sharding, surrogates, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_url_filters": url_filters.query,
    "op4_surrogates": surrogates.query,
    "op5_source_mixing": mixing.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_sharding": sharding.query,
    "op8_sentencepiece": pieces.query,
    "op9_fingerprints": digests.query,
    "op10_toxicity": toxicity.query,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_url_filters": url_filters.ORACLE,
}
