"""Rewriting of articles: links of listed anchors removed or added, paragraphs filtered."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .match import Matcher, _collected, built

_LINK = re.compile(r"\[\[(.*?)\]\]", re.DOTALL)
_SPACES = re.compile(r"\s+")


def surface(x: str, quotes: bool = False) -> str:
    """``norm_surface`` for a part of a normalised text, in Python."""
    x = x.replace(" ", " ").strip().translate(dict.fromkeys(map(ord, t.APOSTROPHES), "'"))
    if quotes:
        x = x.translate(dict.fromkeys(map(ord, t.QUOTES), '"'))
    return _SPACES.sub(" ", x).strip("[]").strip()


def unlinked(text: str, listed: frozenset[str], quotes: bool = False) -> str:
    """Links whose anchor is listed give way to the anchor as written; malformed ones stay."""

    def one(m: re.Match) -> str:
        target, bar, anchor = m[1].strip().partition("|")
        target, anchor = target.strip(), anchor.strip()
        shown = anchor or target
        return shown if target and surface(shown, quotes) in listed else m[0]

    return _LINK.sub(one, text)


def autolinked(text: str, matcher: Matcher, targets: list[str]) -> str:
    """Links added at matches outside links: from the left, the longest first, none overlapping."""
    spans = [m.span() for m in _LINK.finditer(text)]
    starts = [s for s, _ in spans]

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end) - 1  # the last link that begins before the match ends
        return k < 0 or spans[k][1] <= start

    out, at = [], 0
    for start, end, i in sorted((m for m in matcher.matches(text) if free(m[0], m[1])), key=lambda m: (m[0], -m[1])):
        if start >= at:
            out += [text[at:start], "[[", targets[i], "|", text[start:end], "]]"]
            at = end
    return "".join([*out, text[at:]]) if out else text


def unlink(blacklist: DataFrame, quotes: bool = False) -> Callable[[Column], Column]:
    """A column function that removes the links of listed anchors; the list is broadcast, size checked."""
    shared = blacklist.sparkSession.sparkContext.broadcast(frozenset(r.anchor for r in _collected(blacklist, "anchor")))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or "[[" not in x else unlinked(x, shared.value, quotes))

    return run


def autolink(whitelist: DataFrame) -> Callable[[Column], Column]:
    """A column function that links listed anchors to their targets; the list is broadcast, size checked."""
    rows = sorted({r.anchor: r.target for r in _collected(whitelist, "anchor", "target") if r.anchor}.items())
    shared = whitelist.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        matcher, targets = built(shared, lambda rows: (Matcher([a for a, _ in rows]), [target for _, target in rows]))
        return s.map(lambda x: x if not x else autolinked(x, matcher, targets))

    return run


def dense_paragraphs(c: Column, threshold: float = 0.03) -> Column:
    """The paragraphs whose share of linked words is above the threshold."""
    return F.filter(t.paragraphs(c), lambda p: t.link_ratio(p) > threshold)


def filtered(df: DataFrame, text: str = "text", threshold: float = 0.03, keep: tuple[str, ...] = ()) -> DataFrame:
    """``*keep, text, link_ratio``: articles of their dense paragraphs; without any an article goes."""
    # A generator works its paragraphs out once; a filter on them would do so twice.
    dense = F.filter(F.array(dense_paragraphs(F.col(text), threshold)), lambda kept: F.size(kept) > 0)
    rows = df.select(*keep, F.explode(dense).alias("_kept")).select(*keep, F.array_join("_kept", "\n\n").alias("text"))
    return rows.withColumn("link_ratio", t.link_ratio(F.col("text")))


def rewritten(df: DataFrame, blacklist: DataFrame, whitelist: DataFrame, text: str = "text", threshold: float = 0.03, quotes: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normalise, remove listed links, add listed links, filter paragraphs: ``*keep, text, link_ratio float``."""
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "")
    new = autolink(whitelist)(unlink(blacklist, quotes)(t.norm_text(F.col(text), quotes)))
    out = filtered(rows.select(*keep, new.alias("text")), "text", threshold, keep)
    return out.withColumn("link_ratio", F.col("link_ratio").cast("float"))
