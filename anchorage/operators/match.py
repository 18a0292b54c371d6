"""Many patterns in many texts: occurrences outside links, bounded by non-word characters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

#: Patterns are broadcast up to this number; counting takes more of them in blocks.
MOST_PATTERNS = 2_000_000


class Matcher:
    """An automaton over patterns; without patterns it finds nothing."""

    def __init__(self, patterns: list[str]):
        self.patterns = [p for p in patterns if p]
        self.bounded = [_word(p[0]) and _word(p[-1]) for p in self.patterns]
        self.automaton = None
        if self.patterns:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.patterns):
                self.automaton.add_word(p, i)
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``start, end, number`` of all occurrences, overlapping and nested ones too."""
        for last, i in self.automaton.iter(text) if self.automaton else ():
            start, end = last + 1 - len(self.patterns[i]), last + 1
            if self.bounded[i] and (start and _word(text[start - 1]) or end < len(text) and _word(text[end])):
                continue
            yield start, end, i


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def built(shared: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What is made of a broadcast value, once a worker: workers keep the broadcast from task to task."""
    if not hasattr(shared, "_built"):
        shared._built = make(shared.value)
    return shared._built


def _collected(patterns: DataFrame, *columns: str) -> list:
    """A dictionary for broadcasting, its size checked."""
    rows = patterns.select(*columns).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} entries can't be broadcast")
    return rows


def plain_counts(df: DataFrame, patterns: DataFrame, text: str = "text", quotes: bool = False) -> DataFrame:
    """``anchor, freq_text``: occurrences in the normalised text without its links.

    Each task counts its own texts, so few rows are shuffled. Dictionaries beyond the broadcast
    bound are counted in blocks of at most so many patterns, with one pass over the texts each.
    """
    plain = t.strip_links(t.norm_text(F.col(text), quotes)).alias("plain")
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(plain)
    out = None
    for block in _blocks(patterns):
        part = _counted(rows, block)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("anchor").agg(F.sum("n").alias("freq_text"))


def _blocks(patterns: DataFrame) -> Iterator[list[str]]:
    """All patterns in sorted lists of at most MOST_PATTERNS; an empty list if there are none."""
    first = sorted(r.anchor for r in patterns.select("anchor").limit(MOST_PATTERNS + 1).collect())
    if len(first) <= MOST_PATTERNS:
        yield first
        return
    every, last = patterns.select("anchor").distinct(), ""
    while True:
        block = [r.anchor for r in every.where(F.col("anchor") > last).orderBy("anchor").limit(MOST_PATTERNS).collect()]
        if block:
            yield block
        if len(block) < MOST_PATTERNS:
            return
        last = block[-1]


def _counted(rows: DataFrame, block: list[str]) -> DataFrame:
    """``anchor, n`` of one block of patterns, by task."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, found = built(shared, Matcher), Counter()
        for b in batches:
            for x in b.column(0):
                found.update(i for _, _, i in matcher.matches(x.as_py()))
        keys = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([matcher.patterns[i] for i in keys], pa.string()), pa.array([found[i] for i in keys], pa.int64())], ["anchor", "n"])

    return rows.mapInArrow(run, "anchor string, n bigint")


def plain_counts_by_join(df: DataFrame, patterns: DataFrame, text: str = "text", quotes: bool = False) -> DataFrame:
    """The same by an equi-join, for patterns that need word boundaries only.

    Such a match begins and ends with whole runs of word characters: the text's run n-grams, of
    all numbers of runs that patterns have, are joined with the patterns.
    """
    plain = t.strip_links(t.norm_text(F.col(text), quotes)).alias("plain")
    piece = rf"([{t.WORD_CHAR}]+|[^{t.WORD_CHAR}]+)"
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(plain)
    rows = rows.select(F.regexp_extract_all("plain", F.lit(piece), 1).alias("p"))

    def grams(k: int) -> Column:
        last = F.size("p") - (2 * k - 2)
        at = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("p", i, 2 * k - 1), ""))

    wanted = patterns.where(t.needs_boundary(F.col("anchor"))).select("anchor")
    size = F.floor((F.size(F.regexp_extract_all("anchor", F.lit(piece), 1)) + 1) / 2).cast("int")
    runs = sorted(r.k for r in wanted.select(size.alias("k")).distinct().collect()) or [1]
    every = rows.select(F.explode(F.concat(*[grams(k) for k in runs])).alias("anchor"))
    return every.join(wanted, "anchor").groupBy("anchor").agg(F.count("*").alias("freq_text"))
