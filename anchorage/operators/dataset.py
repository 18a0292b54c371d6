"""The labelled dataset: raw text and segments, tokens, BIO tags, class weights, splits."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .ordering import bucketed

IGNORED = -100
MAX_LENGTH = 512
Encoder = Callable[[str], tuple[list[int], list[int], list[tuple[int, int]]]]
_TOKEN = re.compile(r"\w+|[^\w\s]")


def well_formed(c: Column) -> Column:
    """No link on one line with two bars or more."""
    return ~F.exists(F.regexp_extract_all(c, F.lit(t.LINE_LINK), 1), lambda x: F.size(F.split(x, r"\|", -1)) > 2)


def segments(c: Column) -> Column:
    """``start, end, text, in_link`` of the raw text's parts, empty ones left out; for well-formed text."""
    gaps = F.split(c, t.LINE_LINK, -1)
    shown = F.transform(F.regexp_extract_all(c, F.lit(t.LINE_LINK), 1), lambda x: F.element_at(F.split(x, r"\|", -1), -1))
    pairs = F.zip_with(gaps, shown, lambda g, s: F.array(F.struct(g.alias("x"), F.lit(False).alias("l")), F.struct(F.coalesce(s, F.lit("")).alias("x"), F.lit(True).alias("l"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string,in_link:boolean>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s.at + F.length(p.x)
        one = F.struct(s.at.alias("start"), end.alias("end"), p.x.alias("text"), p.l.alias("in_link"))
        return F.struct(end.alias("at"), F.when(p.x != "", F.concat(s.out, F.array(one))).otherwise(s.out).alias("out"))

    return F.aggregate(F.flatten(pairs), begin, step)["out"]


def strip_markup(c: Column) -> Column:
    """The raw text: links give way to what they show."""
    return F.regexp_replace(F.regexp_replace(c, r"\[\[[^\n|]*?\|([^\n|]*?)\]\]", "$1"), t.LINE_LINK, "$1")


def word_encoder(text: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """The default tokenizer: words and signs between two zero-width marks; ids are hashes of 15 bits."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    ids = [1, *[2 + sum(ord(c) * 31**k for k, c in enumerate(text[a : min(b, a + 8)])) % 32_000 for a, b in spans], 2]
    return ids, [1] * len(ids), [(0, 0), *spans, (0, 0)]


def bio(offsets: list[tuple[int, int]], linked: list[tuple[int, int]]) -> list[int]:
    """-100 for (0, 0); else 1 for the first token in a link after one outside, 2 further on, 0 outside.

    Both lists rise, so one walk finds each token's links. Ignored tokens keep the state.
    """
    out, inside, k = [], False, 0
    for a, b in offsets:
        if (a, b) == (0, 0):
            out.append(IGNORED)
            continue
        while k < len(linked) and linked[k][1] <= a:
            k += 1
        hit = b > a and k < len(linked) and linked[k][0] < b
        out.append((2 if inside else 1) if hit else 0)
        inside = hit
    return out


def labelled(df: DataFrame, text: str = "text", encode: Encoder = word_encoder, max_length: int | None = MAX_LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """``*keep, text, input, attention_mask, offset_mapping, output``; malformed and null rows are out.

    With a max_length rows are cut, keeping the closing mark, and padded with (0, 0) tokens.
    """
    rows = df.where(F.col(text).isNotNull() & well_formed(F.col(text)))
    rows = rows.select(*keep, F.col(text).alias("text"), strip_markup(F.col(text)).alias("_raw"), F.transform(F.filter(segments(F.col(text)), lambda s: s.in_link), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias("_linked"))
    names = [*keep, "text", "input", "attention_mask", "offset_mapping", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, pairs = pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            made = []
            for raw, linked in zip(b.column("_raw"), b.column("_linked").to_pylist(), strict=True):
                ids, mask, spans = encode(raw.as_py())
                if max_length and len(ids) > max_length:
                    ids, mask, spans = ids[: max_length - 1] + ids[-1:], mask[:max_length], spans[: max_length - 1] + spans[-1:]
                pad = max(0, (max_length or 0) - len(ids))
                ids, mask, spans = ids + [0] * pad, mask + [0] * pad, spans + [(0, 0)] * pad
                made.append((ids, mask, [{"start": x, "end": y} for x, y in spans], bio(spans, [(s["start"], s["end"]) for s in linked])))
            cols = [pa.array([m[k] for m in made], pairs if k == 2 else ints) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep) + 1)], *cols], names)

    kinds = dict(df.dtypes)
    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return rows.mapInArrow(run, f"{head}text string, input array<int>, attention_mask array<int>, offset_mapping array<struct<start:int,end:int>>, output array<int>")


def label_histogram(df: DataFrame, output: str = "output") -> DataFrame:
    """``label, count`` without ignored labels."""
    rows = df.select(F.explode(output).alias("label")).where(F.col("label") != IGNORED)
    return rows.groupBy("label").agg(F.count("*").alias("count")).orderBy("label")  # a row a class


def class_weights(histogram: DataFrame, classes: int = 3) -> DataFrame:
    """``label, count, weight``: inverse frequency, 1 for the label 0."""
    w = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row a class
    inverse = F.sum("count").over(w) / (classes * F.col("count"))
    rows = histogram.withColumn("weight", inverse)
    return rows.withColumn("weight", F.col("weight") / F.max(F.when(F.col("label") == 0, F.col("weight"))).over(w))


def split(df: DataFrame, key: str, test: float = 0.2, dev: float = 0.1, seed: int | None = 42) -> DataFrame:
    """df with ``part``: test, dev or train, of exact sizes ceil(test n) and ceil(dev rest).

    Rows rank by a seeded hash of their key (by the key itself without a seed). Ranks come from
    counts by hash bucket, so no task sees all rows: only the two buckets that a cut falls into
    are ranked row by row.
    """
    h = F.xxhash64(F.lit(seed), key) if seed is not None else F.col(key).cast("bigint")
    n = df.count()
    tests = math.ceil(test * n)
    cuts = [tests, tests + math.ceil(dev * (n - tests))]
    keyed = bucketed(df.withColumn("_h", h), "_h")
    open_ = F.lit(False)
    for c in cuts:
        open_ = open_ | ((F.col("_before") < c) & (F.col("_before") + F.col("_n") > c))
    rank = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) + F.col("_before") - 1
    cut = keyed.where(open_).withColumn("_r", rank)
    rows = cut.unionByName(keyed.where(~open_).withColumn("_r", F.col("_before")))
    part = F.when(F.col("_r") < cuts[0], "test").when(F.col("_r") < cuts[1], "dev").otherwise("train")
    return rows.withColumn("part", part).drop("_h", "_b", "_n", "_before", "_r")
