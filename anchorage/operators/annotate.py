"""Tags of tokens: choice, smoothing, scores, and rendering as HTML anchors."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import IGNORED, Encoder, word_encoder
from .match import Matcher, _collected, built
from .ordering import ranked

#: Where a link without a known page leads (a fixed value).
SEARCH = "https://fr.wikipedia.org/w/index.php?search="
Predictor = Callable[[str, list[tuple[int, int]]], list[int]]


def argmax(logits: Column) -> Column:
    """The place of the largest value, from 0; the first of equal ones."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def smoothed(tags: Column) -> Column:
    """Fills a 0 between two tags with 2, then drops a tag between two 0 (not in the last two places)."""
    at = lambda x, i: F.get(x, i)
    n = F.size(tags)
    filled = F.transform(tags, lambda x, i: F.when((i >= 1) & (i < n - 1) & (x == 0) & (at(tags, i - 1) > 0) & (at(tags, i + 1) > 0), 2).otherwise(x))
    return F.transform(F.array(filled), lambda f: F.transform(f, lambda x, i: F.when((i >= 1) & (i < n - 2) & (x > 0) & (at(f, i - 1) == 0) & (at(f, i + 1) == 0), 0).otherwise(x)))[0]


def token_accuracy(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """``tokens, correct, accuracy`` over labels that count; accuracy 0 without any."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col(gold).alias("g"))).alias("x")).where(F.col("x.g") != IGNORED)
    rows = pairs.agg(F.count("*").alias("tokens"), F.count_if(F.col("x.p") == F.col("x.g")).alias("correct"))
    return rows.withColumn("accuracy", F.when(F.col("tokens") > 0, F.col("correct") / F.col("tokens")).otherwise(0.0))


def mean_loss(df: DataFrame, logits: str, gold: str, key: str, weights: list[float] | None = None, batch: int = 128) -> DataFrame:
    """``loss``: the sum over batches of 128 rows, by key, of weighted cross entropy, by n // 128 + 1."""
    w = F.array(*[F.lit(float(x)) for x in weights or (1.0, 1.0, 1.0)])
    rows = ranked(df.select(key, logits, gold), key, "_rank").withColumn("_batch", F.floor(F.col("_rank") / batch))
    tokens = rows.select("_batch", F.explode(F.arrays_zip(F.col(logits).alias("z"), F.col(gold).alias("g"))).alias("x")).where(F.col("x.g") != IGNORED)
    z, g = F.col("x.z"), F.col("x.g")
    top = F.array_max(z)
    nll = F.log(F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top - F.get(z, g)
    sums = tokens.groupBy("_batch").agg((F.sum(nll * F.get(w, g)) / F.sum(F.get(w, g))).alias("loss"))
    n = df.agg(F.count("*").alias("n"))
    return sums.agg(F.sum("loss").alias("loss")).crossJoin(n).select((F.col("loss") / (F.floor(F.col("n") / batch) + 1)).alias("loss"))  # two single rows


def rendered(text: str, offsets: list[tuple[int, int]], tags: list[int]) -> str:
    """Anchors over tagged tokens.

    A tag opens or goes on with an anchor, a 0 closes it; its text runs to the start of the closing
    token, or to the end of the text. Tokens of no width don't matter.
    """
    out, at, opened = [], 0, None

    def close(end: int) -> None:
        shown = text[opened:end]
        out.append(f'<a href="{SEARCH}{quote(shown)}" >{shown}</a>')

    for (a, b), tag in zip(offsets, tags, strict=True):
        if a == b:
            continue
        if tag > 0 and opened is None:
            out.append(text[at:a])
            opened = a
        elif tag == 0 and opened is not None:
            close(a)
            at, opened = a, None
    if opened is not None:
        close(len(text))
        at = len(text)
    return "".join([*out, text[at:]])


def smooth_list(tags: list[int]) -> list[int]:
    """``smoothed`` for one list."""
    x, n = list(tags), len(tags)
    for i in range(1, n - 1):
        if x[i] == 0 and x[i - 1] > 0 and x[i + 1] > 0:
            x[i] = 2
    y = list(x)
    for i in range(1, n - 2):
        if x[i] > 0 and x[i - 1] == 0 and x[i + 1] == 0:
            y[i] = 0
    return y


def dictionary_predictor(entries: list[str]) -> Predictor:
    """Tags tokens inside matches of a dictionary: the default where no trained model is given."""
    matcher = Matcher(entries)

    def predict(text: str, offsets: list[tuple[int, int]]) -> list[int]:
        spans, end = [], 0
        for a, b, _ in sorted(matcher.matches(text), key=lambda m: (m[0], -m[1])):
            if a >= end:
                spans.append((a, b))
                end = b
        out, k = [], 0
        for a, b in offsets:
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            hit = b > a and k < len(spans) and spans[k][0] < b
            out.append((1 if spans[k][0] >= a else 2) if hit else 0)
        return out

    return predict


def annotate(df: DataFrame, dictionary: DataFrame, text: str = "text", to: str = "html", encode: Encoder = word_encoder, predictor: Callable[[list[str]], Predictor] = dictionary_predictor) -> DataFrame:
    """df with its text as HTML: tokens, tags, smoothing, anchors. Null text gives null."""
    shared = df.sparkSession.sparkContext.broadcast(sorted({r[0] for r in _collected(dictionary, "anchor") if r[0]}))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        predict = built(shared, predictor)

        def one(x: str | None) -> str | None:
            if x is None:
                return None
            _, _, spans = encode(x)
            return rendered(x, spans, smooth_list(predict(x, spans)))

        return s.map(one)

    return df.withColumn(to, run(F.col(text)))
