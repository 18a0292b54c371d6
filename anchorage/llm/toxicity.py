"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade <= k) = sigmoid(theta_k - w.x)``: all ordered thresholds share the weights. The model
is trained here, on a bounded sample of labelled documents. Labels say toxic or not; grades of
toxic ones follow from how many words that mark toxic labels a text repeats.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, tidy, without

WORD = re.compile(r"\w+")
#: Labelled documents of each class that are sampled at most, by the hash of their id.
SAMPLE = {1: 1500, 0: 4500}
#: Toxic documents are grade 1, 2 or 3 as they have fewer marker words than the first bound, the second, or not.
GRADE_BOUNDS = (3, 6)
#: Lengths of the beginnings of words that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_G2, MOST_FEATURES = 5, 15.0, 4000
RIDGE = 0.02
REJECT = 0.5


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of the grades 0 .. K, a row each score."""
        below = _sigmoid(self.thresholds[None, :] - np.asarray(score, float)[:, None])
        return np.diff(np.c_[np.zeros(len(below)), below, np.ones(len(below))], axis=1)

    def scores(self, texts: Iterable[str | None], lookup: _Lookup) -> np.ndarray:
        return np.array([sum(self.weights[i] * v for i, v in vector(t, lookup).items()) for t in texts], float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def parts(word: str) -> tuple[str, ...]:
    """A word's features: itself and, marked by a caret, its beginnings of PREFIXES characters."""
    return (word, *["^" + word[:k] for k in PREFIXES if k <= len(word)])


class _Lookup(dict):
    """Feature indices of words, worked out once a distinct word; emptied when large."""

    def __init__(self, features: dict[str, int]):
        self.features = features

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = found = tuple(self.features[p] for p in parts(word) if p in self.features)
        return found


def words(text: str | None) -> Counter[str]:
    """How often a text has each of its words."""
    return Counter(WORD.findall((text or "").lower()))


def vector(text: str | None, lookup: _Lookup) -> dict[int, float]:
    """Sparse features: log(1 + count) of each known one. Length does not dilute them."""
    counts: dict[int, int] = {}
    for w, n in words(text).items():
        for i in lookup[w]:
            counts[i] = counts.get(i, 0) + n
    return {i: float(np.log1p(c)) for i, c in counts.items()}


class Corpus:
    """Counted words of labelled texts as arrays: numbers of the words of each text, and how often it has them."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.toxic: list[int] = []

    def add(self, own: Iterable[str], counts: Iterable[int], toxic: int) -> None:
        numbers = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in own], np.int32)
        self.rows.append((numbers, np.array(counts, np.int32)))
        self.toxic.append(toxic)

    def expanded(self, of: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the distinct values that its words have in ``of``, and the sums of their counts."""
        sizes = np.array([len(x) for x in of], np.int64)
        ends, flat = np.cumsum(sizes), np.fromiter((i for x in of for i in x), np.int64, int(sizes.sum()))
        for numbers, counts in self.rows:
            n = sizes[numbers]
            at = np.arange(n.sum()) + np.repeat(ends[numbers] - np.cumsum(n), n)
            values, where = np.unique(flat[at], return_inverse=True)
            yield values, np.bincount(where, np.repeat(counts, n), len(values))


def select_features(corpus: Corpus) -> dict[str, int]:
    """Words and beginnings whose presence goes with the label: G2 test on document counts, most telling first."""
    toxic = np.array(corpus.toxic, int)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    every: dict[str, int] = {}
    of = [tuple(every.setdefault(p, len(every)) for p in parts(w)) for w in corpus.numbers]
    seen = np.zeros((2, len(every)), np.int64)
    for (present, _), y in zip(corpus.expanded(of), toxic, strict=True):
        seen[y, present] += 1
    total, scored = seen.sum(axis=0), []
    for w, k in every.items():
        a, b = int(total[k]), int(seen[1, k])
        if a < LEAST_DOCS:
            continue
        g = 0.0
        for k, n, m in ((b, n1, a), (a - b, n0, a)):
            for x, row in ((k, m), (n - k, n1 + n0 - m)):
                if x:
                    g += 2 * x * np.log(x * (n1 + n0) / (row * n))
        if g >= LEAST_G2:
            scored.append((-g, w))
    return {w: i for i, (_, w) in enumerate(sorted(scored)[:MOST_FEATURES])}


def fit(texts: list[str | None], toxic: list[int], ridge: float = RIDGE) -> OrdinalModel:
    """The model of labelled texts."""
    corpus = Corpus()
    for t, y in zip(texts, toxic, strict=True):
        own = words(t)
        corpus.add(own.keys(), list(own.values()), y)
    return fit_words(corpus, ridge)


def fit_words(corpus: Corpus, ridge: float = RIDGE) -> OrdinalModel:
    """Fits thresholds and shared weights by damped gradient steps with momentum on counted words."""
    y = np.array(corpus.toxic, int)
    features = select_features(corpus)
    lookup = _Lookup(features)
    of = [lookup[w] for w in corpus.numbers]
    rows = list(corpus.expanded(of))
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    docs = np.zeros((2, len(features)))  # of each feature, by label
    for (i, _), t in zip(rows, y, strict=True):
        docs[t, i] += 1
    markers = set(np.flatnonzero(docs[1] / n1 > 10 * (docs[0] + 1) / n0).tolist())
    marks = np.array([not markers.isdisjoint(x) for x in of], bool)
    hits = np.array([c[marks[k]].sum() for k, c in corpus.rows], int)
    grade = np.where(y == 1, 1 + np.searchsorted(GRADE_BOUNDS, hits, side="right"), 0)
    levels = len(GRADE_BOUNDS) + 1
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    col = np.concatenate([i for i, _ in rows]).astype(int) if rows else np.zeros(0, int)
    val = np.log1p(np.concatenate([c for _, c in rows])) if rows else np.zeros(0)
    w = np.zeros(len(features))
    # Thresholds rise: the first and logs of the gaps are free.
    share = np.clip([np.mean(grade <= k) for k in range(levels)], 0.01, 0.99) if len(grade) else np.linspace(0.6, 0.9, levels)
    theta = np.log(share / (1 - share))
    free = np.r_[theta[0], np.log(np.maximum(np.diff(theta), 0.05))]
    m, v = np.zeros(len(w) + levels), np.zeros(len(w) + levels)
    for step in range(1, 601):
        theta = free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]
        s = np.bincount(at, val * w[col], len(rows)) if len(col) else np.zeros(len(rows))
        edges = np.r_[-np.inf, theta, np.inf]
        hi, lo = _sigmoid(edges[grade + 1] - s), _sigmoid(edges[grade] - s)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dhi - dlo) / max(1, len(rows))  # of the loss by the score
        gw = (np.bincount(col, val * ds[at], len(w)) if len(col) else np.zeros(len(w))) + ridge / max(1, len(rows)) * w
        gt = np.array([(dlo[grade == k + 1].sum() - dhi[grade == k].sum()) / max(1, len(rows)) for k in range(levels)])
        gf = np.r_[gt.sum(), [gt[k:].sum() * np.exp(free[k]) for k in range(1, levels)]]
        g = np.r_[gw, gf]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, free = w - move[: len(w)], free - move[len(w) :]
    return OrdinalModel(features, w, free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))])


def sample(docs: DataFrame, labels: DataFrame) -> Corpus:
    """Counted words and label of at most SAMPLE labelled documents of each class.

    Executors count the words of the whole texts, so the driver holds numbers and one vocabulary.
    Ids of 6000 rows are broadcast. Rows that repeat an id count as one: the least of their texts' hashes.
    """
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for toxic, most in SAMPLE.items():
        some = rows.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [sorted(words(t.as_py()).items()) for t in b.column(2)]
            cols = [pa.array([[x[k] for x in c] for c in counted], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *cols], ["doc_id", "toxic", "hash", "words", "counts"])

    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text", F.xxhash64("text").alias("hash"))
    found = found.mapInArrow(tidy(count), f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, hash bigint, words array<string>, counts array<int>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("hash", "toxic", "words", "counts")).alias("x")).orderBy("doc_id").select("x.*")
    corpus = Corpus()
    for r in one.toLocalIterator():
        corpus.add(r.words, r.counts, r.toxic)
    return corpus


def train(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Without labels the model has no features and calls every text clean."""
    corpus = sample(docs, labels)
    return fit_words(corpus) if corpus.rows else OrdinalModel({}, np.zeros(0), np.array([4.0, 5.0, 6.0]))


def graded(df: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """df with ``severity`` (expected grade, 0 to 3), ``grade`` (likeliest) and ``p_toxic``.

    Whole texts, also very long ones; null and empty texts score as a text without known words.
    Repeated rows get equal grades, an empty table gives no rows, and columns of df that have the
    name of a result give way to it. The model, at most MOST_FEATURES words, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = without(df, "severity", "grade", "p_toxic")
    at = df.columns.index(text)
    names = [*df.columns, "severity", "grade", "p_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup = _Lookup(m.features)
        for b in batches:
            p = m.grades(m.scores((t.as_py() for t in b.column(at)), lookup))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(1 - p[:, 0])], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(tidy(run), f"{kinds}, severity double, grade int, p_toxic double")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are more likely of grade 0 than not, with docs' columns, whatever their names."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    kept = graded(docs.select("text", others), train(docs, labels)).where(F.col("p_toxic") < REJECT)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = graded(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "severity", "grade", "p_toxic", (F.col("p_toxic") >= REJECT).alias("rejected"))
