"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over the URL with the literal tokens that any match contains.
Each rule lies in the index under the one of its tokens that fewest URLs have; a URL's tokens
fetch candidate rules, and only those run their expressions. Of the rules that match, the longest
wins, then the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import without

TOKEN = re.compile(r"[a-z0-9]+")
#: The rule list is broadcast; longer ones are an error.
MOST_RULES = 1_000_000
#: The method's verdict where no rule fits.
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    """A domain rule: fits a host and its subdomains where the path starts with its path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that each match holds whole: the host's, and the path's that end inside it."""
        closed = re.sub(r"[A-Za-z0-9]+\Z", "", self.path)
        return TOKEN.findall(self.host) + TOKEN.findall(closed.lower())


def literals(expression: str) -> list[str]:
    """Runs of characters that each match of an expression holds, with ``^`` and ``$`` where it is bound there.

    Only the top level counts: groups, classes and what a quantifier may leave out end a run, and
    an alternation outside groups leaves none.
    """
    runs, run, i = [], "", 0
    while i < len(expression):
        c, known = expression[i], None
        if c == "\\" and i + 1 < len(expression):
            known = None if expression[i + 1].isalnum() else expression[i + 1]
            i += 2
        elif c == "[":
            i = expression.index("]", i + (3 if expression.startswith("[^", i) else 2)) + 1
        elif c == "(":
            depth, i = 1, i + 1
            while depth:
                if expression[i] == "[":
                    i = expression.index("]", i + (3 if expression.startswith("[^", i) else 2))
                depth += {"(": 1, ")": -1}.get(expression[i], 0)
                i += 2 if expression[i] == "\\" else 1
        elif c == "|":
            return []
        else:
            known = None if c == "." else c
            i += 1
        after = expression[i : i + 1]
        if c in "^$":
            run += c
        elif known is None or (after and after in "*?{"):
            runs.append(run)
            run = ""
        else:
            run += known
            if after == "+":
                runs.append(run)
                run = ""
        while after and after in "*?+{":
            i = expression.index("}", i) + 1 if after == "{" else i + 1
            after = expression[i : i + 1]
    return [r for r in [*runs, run] if r]


@dataclass(frozen=True)
class Pattern:
    """A rule by expression: fits where it is found in the host and path, which a line end parts."""

    verdict: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    @property
    def tokens(self) -> list[str]:
        """Tokens that each match holds whole: those in its literals that other characters enclose."""
        return [t for run in literals(self.pattern) for t in re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", run.lower())]


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = _HOST.match(rest)
    return m[1].translate(_LOWER), m[2]


_HOST = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Index:
    """Rules by their rarest token; a rule without any is tried on every URL."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.rest: list[int] = []
        self.rules = rules
        compiled = [re.compile(r.pattern, re.DOTALL) for r in rules]
        self.fits = [c.search if isinstance(r, Pattern) else c.match for c, r in zip(compiled, rules, strict=True)]
        for i, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
            else:
                self.rest.append(i)

    def judge(self, host: str, path: str) -> int | None:
        """The number of the rule that wins."""
        subject = f"{host}\n{path}"
        tried = {i for t in set(TOKEN.findall(subject.lower())) for i in self.by_token.get(t, ())}
        fits = [i for i in [*tried, *self.rest] if self.fits[i](subject)]
        return min(fits, key=lambda i: (-len(self.rules[i].name), i), default=None)


def token_frequency(urls: DataFrame, column: str, rules: list[Rule | Pattern]) -> dict[str, int]:
    """How many URLs have each token of the rules: all rows, one small row a token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    words = F.array_distinct(F.split(F.lower(F.col(column)), "[^a-z0-9]+"))
    found = urls.select(F.explode(words).alias("token")).join(F.broadcast(tokens), "token")  # as large as the rules
    return {r.token: r["count"] for r in found.groupBy("token").count().collect()}


def judged(df: DataFrame, rules: list[Rule | Pattern] | tuple[Rule | Pattern, ...] = RULES, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """df with ``host, path, rule, verdict``; columns of df of these names give way to them.

    Each row is judged by itself, so repeated rows agree; URLs may be long. Null and what has no
    ``://`` has an empty host and path. Of rules of one length the first wins. An empty table
    gives no rows.
    """
    df = without(df, "host", "path", "rule", "verdict")
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = df.sparkSession.sparkContext.broadcast((rules, token_frequency(df, url, rules)))
    at, names = df.columns.index(url), [*df.columns, "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in batches:
            split = [parts(u) for u in b.column(at).to_pylist()]
            won = [index.judge(*p) for p in split]
            cols = [[p[0] for p in split], [p[1] for p in split], [None if i is None else rules[i].name for i in won], [default if i is None else rules[i].verdict for i in won]]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.string()) for c in cols]], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
