"""The ten operators against brute force, round trips and hand-made cases."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from anchorage.llm import base, digests, exact_dedup, jaccard_join, licenses, mixing, pieces, queries, sharding, surrogates, toxicity, url_filters

DOCS = "doc_id bigint, text string, source string"
PROSE = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, PROSE, "a"), (2, PROSE + "\n", "a"), (3, PROSE.replace("w30", "zz"), None), (4, None, "b"), (5, "", "b"), (6, " \t ", None),
    (7, "x " * 5000, "a"), (8, "short text", "c"), (9, "short text", "c"), (9, "short text", "c"), (None, "no id", "c"), (10, PROSE + " w60", "é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("modulus", [exact_dedup.MODULUS, 3])
def test_exact_dedup(docs, none, modulus):
    got = exact_dedup.exact_dedup(docs, modulus=modulus).collect()
    assert len(got) == len(ROWS) and exact_dedup.exact_dedup(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[1].keep_id, by[2].keep_id, by[1].group_size) == (2, 2, 2)
    assert {by[i].keep_id for i in (4, 5, 6)} == {6} and by[6].group_size == 3
    assert by[8].keep_id == 8 and by[9].group_size == 3 and by[None].kept
    assert sum(r.kept for r in got) == 7
    assert by[1].text_sha256 == hashlib.sha256(PROSE.replace(" ", "").encode()).hexdigest()
    assert exact_dedup.keep_first_copies(docs).count() == 7


def test_exact_dedup_of_huge_texts(spark, monkeypatch):
    """Cut texts are the same as whole ones, a hot group of large texts is salted, columns may have any names."""
    monkeypatch.setattr(exact_dedup, "HUGE", 1000)
    monkeypatch.setattr(exact_dedup, "PART", 333)
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", 5000)
    long = "é word " * 1000
    rows = [(k, long + " " * k, "x", 1, True) for k in range(30)] + [(50, long + ".", "x", 1, True), (51, "short", "x", 1, True), (52, "s h o r t", "x", 1, True), (53, "é" * 900, "x", 1, True), (54, "é" * 900 + " " * 200, "x", 1, True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n string, row int, kept boolean")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df).collect()}
    assert {got[k].keep_id for k in range(30)} == {29} and got[3].group_size == 30 and got[50].kept and got[51].keep_id == 52 and got[53].keep_id == 54
    assert all(got[i].text_sha256 == hashlib.sha256(exact_dedup.normalise(t.encode())).hexdigest() for i, t, *_ in rows)
    kept = exact_dedup.keep_first_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [29, 50, 52, 54]


def test_fingerprints_compose(spark):
    text = "".join(chr(33 + random.Random(2).randrange(90)) + "é" for _ in range(120_000))
    cuts = [0, 5, 70_000, 70_001, 200_000, len(text)]
    parts = spark.createDataFrame([(1, k, text[a:b]) for k, (a, b) in enumerate(itertools.pairwise(cuts))] + [(2, 0, text)], "k long, seq int, part string")
    got = exact_dedup.fingerprint_parts(parts, "k", "seq", "part").collect()
    assert len(got) == 2 and tuple(got[0])[1:] == tuple(got[1])[1:]
    assert exact_dedup.same_stream("a b" * 99_999, "ab " * 99_999) and not exact_dedup.same_stream("ab", "abc")


def test_jaccard_of_odd_texts(spark):
    """A text of megabytes and its copy, null ids, string ids."""
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [("a", long), ("b", long + " end"), (None, "one two three four five six"), (None, "one two three four five six"), ("c", "!?")]
    got = sorted((str(r.doc_id), str(r.class_id), r.links) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("None", "None", 1), ("None", "None", 1), ("a", "a", 1), ("b", "a", 1), ("c", "c", 0)]


def test_jaccard_against_all_pairs(spark, none):
    rng = random.Random(3)
    base = [[f"t{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))] for _ in range(60)]
    rows = []
    for words in base:
        for _ in range(rng.randrange(1, 5)):
            w = list(words)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "n" + str(rng.randrange(9))
            rows.append(" ".join(w))
    rows += ["", None, "one", "one", " ".join(base[0]) + " " + " ".join(base[1])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in jaccard_join.classes(df).collect()}
    sets = [set(jaccard_join.shingles(x).tolist()) for x in rows]
    links, root = [0] * len(rows), list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert [got[i].links for i in range(len(rows))] == links and [got[i].class_id for i in range(len(rows))] == root
    assert jaccard_join.classes(none).count() == 0


def components_of(rows, threshold=0.8):
    """Classes by all pairs: for each text's place the least place of its class."""
    sets = [frozenset(jaccard_join.shingles(x).tolist()) for x in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(rows))]


def edited_copies(rng, words, copies, most, name):
    out = []
    for i in range(copies):
        w = list(words)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"{name}{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("few", "deepest"), [(16, 16), (1, 8), (1, 4)])
def test_jaccard_large_buckets(spark, monkeypatch, few, deepest):
    """Near copies beyond a block, strays that share most of their text, and chains between groups:
    classes as by all pairs, whether strays meet all blocks, buckets are split, or blocks meet in pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "DEEPEST", deepest)
    rng = random.Random(9)
    words = [f"p{k}" for k in range(120)]
    rows = edited_copies(rng, words, 150, 2, "v")  # around one original
    rows += edited_copies(rng, words[:80] + [f"q{k}" for k in range(40)], 60, 2, "u")  # shares much with it, is not linked
    chain = list(words)
    for step in range(12):  # leads away from the original, link by link
        chain[step * 5] = f"c{step}"
        rows.append(" ".join(chain))
    rows += [" ".join(words[:60] + [f"s{k}w{i}" for i in range(60)]) for k in range(40)]  # a passage that strays share
    got = {r.doc_id: r for r in jaccard_join.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    want = components_of(rows)
    assert [got[i].class_id for i in range(len(rows))] == want
    assert all((got[i].links > 0) == (want.count(want[i]) > 1) for i in got)


def test_jaccard_links_in_large_buckets(spark, monkeypatch):
    """Near copies beyond a block, by one edit and by many, with exact copies: each document's links as by all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "FEW", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    rng = random.Random(4)
    words = [f"p{k}" for k in range(120)]
    rows = edited_copies(rng, words, 150, 1, "v") + edited_copies(rng, words, 100, 3, "u") + edited_copies(rng, words[:90], 40, 2, "x")
    rows += rows[40:60] + edited_copies(rng, [f"q{k}" for k in range(60)], 90, 0, "q") + edited_copies(rng, words[50:], 9, 1, "y")
    got = {r.doc_id: r for r in jaccard_join.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    sets = [frozenset(jaccard_join.shingles(x).tolist()) for x in rows]
    links = [sum(len(x & y) >= 0.8 * len(x | y) for y in sets) - 1 for x in sets]
    assert [got[i].links for i in range(len(rows))] == links and len(set(links)) > 20
    assert [got[i].class_id for i in range(len(rows))] == components_of(rows)


def join_rows(spark, after=0):
    """Rows that joins of SQL executions from this one on made, and the number of executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    found, rows = store.executionsList(), 0
    for k in range(after, found.size()):
        number = found.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows, found.size()


def test_components_join_few_rows(spark):
    """A group linked by a forest in each of 14 runs, a chain and a star around the largest number: the
    joins' rows are a few times the edges, and roots are the least numbers."""
    rng = random.Random(6)
    edges = [(rng.randrange(i), i) for _ in range(14) for i in range(1, 800)]
    edges += [(i, i + 1) for i in range(1000, 1300)] + [(i, 2000) for i in range(1500, 1600)] + [(7, 7)]
    nodes = spark.range(2100).select(F.col("id").alias("sid"))
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    scratch = jaccard_join.Scratch(spark)
    _, before = join_rows(spark)
    roots = scratch.save(jaccard_join.components(nodes, table, scratch))
    rows, _ = join_rows(spark, before)
    want = {i: 0 if i < 800 else 1000 if 1000 <= i <= 1300 else 1500 if 1500 <= i < 1600 or i == 2000 else i for i in range(2100)}
    assert {r.sid: r.root for r in roots.collect()} == want
    assert 0 < rows <= 4 * len(edges)
    assert jaccard_join.components(nodes, table.limit(0), scratch).where("root = sid").count() == 2100


def test_jaccard_sets_move_to_few_groups(spark):
    """Two sets that share three groups are compared in one of them."""
    text = [" ".join([f"m{k}" for k in range(60)] + [f"e{i}"]) for i in range(2)]
    sets = [jaccard_join.shingles(t) for t in text]
    rows = [(g, i, i, jaccard_join.sketch(x).tobytes(), [3, 5, 9]) for g in (3, 5, 9) for i, x in enumerate(sets)]
    groups = spark.createDataFrame(rows, "gid bigint, sid bigint, root bigint, mh binary, gids array<bigint>").coalesce(1).sortWithinPartitions("gid")
    got = groups.mapInArrow(jaccard_join._screen(jaccard_join.screen_for(0.8)), "gid bigint, sid bigint, root bigint").collect()
    assert sorted((r.gid, r.sid) for r in got) == [(3, 0), (3, 1)]


def test_jaccard_rows_grow_with_the_sets(spark, monkeypatch):
    """20,000 near copies in one bucket, with some strays: about two rows a set, in groups of a block."""
    monkeypatch.setattr(jaccard_join, "DEPTH", 1)
    n = 20_000
    sets = spark.range(n).select(F.col("id").alias("sid"), F.expr("unhex(repeat('00', 256))").alias("mh"))
    roots = sets.select("sid", F.when(F.col("sid") < n - 100, F.lit(0)).otherwise(F.col("sid")).cast("bigint").alias("root"))
    large = sets.select(F.lit(7).cast("bigint").alias("path"), "sid")
    groups = jaccard_join._open(large, sets, roots, jaccard_join.Scratch(spark)).groupBy("gid").agg(F.count("*").alias("n"))
    r = groups.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    assert n <= r.rows <= 2 * n and r.most <= 1.5 * jaccard_join.BLOCK
    same = roots.select("sid", F.lit(0).cast("bigint").alias("root"))
    assert jaccard_join._open(large, sets, same, jaccard_join.Scratch(spark)).count() == 0


def test_jaccard_rows_of_strays_that_are_alike(spark, monkeypatch):
    """600 sets that share three quarters of their sketch, each a class of its own, in two buckets: a row a set."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "FEW", 16)
    rng = random.Random(3)
    tokens = [b"".join((0 if rng.random() < 0.87 else rng.randrange(1, 1 << 32)).to_bytes(4, "little") for _ in range(jaccard_join.COORDINATES)) for _ in range(600)]
    sets = spark.createDataFrame(list(enumerate(tokens)), "sid bigint, mh binary")
    roots = sets.select("sid", F.col("sid").alias("root"))
    large = sets.select("sid", F.explode(F.array(F.lit(7), F.lit(8)).cast("array<bigint>")).alias("path"))
    groups = jaccard_join._open(large, sets, roots, jaccard_join.Scratch(spark))
    assert groups.count() == 600 and groups.select("gid").distinct().count() == 1


def test_jaccard_links_among_strays_that_are_alike(spark, monkeypatch):
    """Copies with so many edits that some are linked and most are not, in large buckets: classes and links as by all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    across, met = jaccard_join._across, []
    monkeypatch.setattr(jaccard_join, "_across", lambda groups, *a: met.append(groups.count()) or across(groups, *a))
    rng = random.Random(8)
    words = [f"p{k}" for k in range(120)]
    rows = edited_copies(rng, words, 220, 5, "v") + edited_copies(rng, words[:100] + [f"q{k}" for k in range(9)], 60, 4, "u")
    got = {r.doc_id: r for r in jaccard_join.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    sets = [frozenset(jaccard_join.shingles(x).tolist()) for x in rows]
    assert met and met[0] > 0
    assert [got[i].class_id for i in range(len(rows))] == components_of(rows) and len(set(components_of(rows))) > 20
    assert [got[i].links for i in range(len(rows))] == [sum(len(x & y) >= 0.8 * len(x | y) for y in sets) - 1 for x in sets]


def test_jaccard_links_across_blocks(spark):
    """Classes that are linked in a group, by core sets or others, are connected; one class and strays get no links."""
    rng = random.Random(5)
    words = [f"p{k}" for k in range(120)]
    rows = edited_copies(rng, words, 40, 3, "v") + edited_copies(rng, [f"q{k}" for k in range(60)], 5, 0, "q")[:1] + edited_copies(rng, words[:80], 3, 1, "x")
    texts = spark.createDataFrame([(t,) for t in dict.fromkeys(rows)], "text string").withColumn("th", jaccard_join._text_hash("text"))
    nodes, sets = [], []
    for i, r in enumerate(texts.collect()):
        sets.append(jaccard_join.shingles(r.text))
        nodes.append((i, 1, *jaccard_join._signature(sets[-1]), r.th, jaccard_join.sketch(sets[-1]).tobytes()))
    table = spark.createDataFrame(nodes, "sid bigint, copies bigint, sa bigint, sb bigint, th bigint, mh binary")
    scratch = jaccard_join.Scratch(spark)
    groups = table.select(F.lit(3).cast("bigint").alias("gid"), "sid", F.col("sid").alias("root"))
    edges = jaccard_join._across(groups, table, texts, scratch, 0.8)
    got = {r.sid: r.root for r in jaccard_join.components(table, edges, scratch).collect()}
    assert [got[i] for i in range(len(sets))] == components_of([r.text for r in texts.collect()])
    assert jaccard_join._across(groups.withColumn("root", F.lit(0).cast("bigint")), table, texts, scratch, 0.8).count() == 0


def shuffled_bytes(spark, name, run):
    """Bytes that the jobs of a call write for others to read, with joins that do not broadcast."""
    sc, threshold = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.conf.set(threshold, before)
        for key in ("spark.jobGroup.id", "spark.job.description"):
            sc.setLocalProperty(key, None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {i for j in tracker.getJobIdsForGroup(name) for i in tracker.getJobInfo(j).stageIds}
    moved = 0
    for i in stages:
        try:
            moved += store.lastStageAttempt(i).shuffleWriteBytes()
        except Py4JJavaError:  # skipped, and forgotten first: another job has written its rows
            pass
    return moved


def test_jaccard_shingles_move_twice(spark):
    """Shingle sets move to one place from their texts, and from there to their group."""
    rng = random.Random(9)
    rows = edited_copies(rng, [f"p{k}" for k in range(4000)], 30, 3, "v")
    rows = [t + f" end{i}" for i, t in enumerate(rows)]
    texts = spark.createDataFrame([(t,) for t in rows], "text string").withColumn("th", jaccard_join._text_hash("text"))
    sets = [jaccard_join.shingles(t) for t in rows]
    facts = [(i, 1, *jaccard_join._signature(x), r.th, jaccard_join.sketch(x).tobytes()) for i, (x, r) in enumerate(zip(sets, texts.collect(), strict=True))]
    scratch = jaccard_join.Scratch(spark)
    nodes = scratch.save(spark.createDataFrame(facts, "sid bigint, copies bigint, sa bigint, sb bigint, th bigint, mh binary"))
    groups = scratch.save(nodes.select(F.lit(3).cast("bigint").alias("gid"), "sid", F.col("sid").alias("root")))
    found = []
    moved = shuffled_bytes(spark, "shingles", lambda: found.append(jaccard_join._found(groups, nodes, texts, scratch, 0.8, True)))
    assert {r.a: r.links for r in found[0].where("b is null").collect()} == dict.fromkeys(range(30), 29)
    size = sum(x.nbytes for x in sets)
    assert 1.5 * size < moved < 2.5 * size


def test_jaccard_other_sketches_stay(spark, monkeypatch):
    """Where 200 of 4000 sets are in buckets that are split, the others' sketches do not move."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    monkeypatch.setattr(jaccard_join, "FEW", 16)
    rng = np.random.default_rng(4)
    tokens = [rng.integers(0, 1 << 32, jaccard_join.COORDINATES, np.uint32).tobytes() for _ in range(4000)]
    scratch = jaccard_join.Scratch(spark)
    nodes = scratch.save(spark.createDataFrame([(i, 9, x) for i, x in enumerate(tokens)], "sid bigint, n int, mh binary"))
    roots = scratch.save(nodes.select("sid", F.col("sid").alias("root")))
    large = scratch.save(nodes.where("sid < 200").select(F.lit(7).cast("bigint").alias("path"), "sid"))
    groups = []
    moved = shuffled_bytes(spark, "sketches", lambda: groups.append(jaccard_join._open(large, nodes, roots, scratch)))
    assert groups[0].count() == 0  # all fall apart
    assert moved < sum(map(len, tokens)) / 2


def test_jaccard_recall_is_averaged_over_sketches():
    runs = jaccard_join.runs_for(0.999)
    rng = np.random.default_rng(1)
    agree = rng.binomial(64, 0.8, 200_000) / 64
    missed = np.mean([(1 - jaccard_join.survival(jaccard_join.DEPTH, a)) ** runs for a in np.unique(agree) for _ in range(int((agree == a).sum()))])
    assert missed <= 0.0013 and jaccard_join.runs_for(0.9999) > runs >= 5
    assert jaccard_join.screen_for(0.8) >= 30 > jaccard_join.screen_for(0.6) > jaccard_join.screen_for(0.3)


def test_jaccard_links_of_a_group_stay_connected():
    """A star of two pairs and a chain: the least neighbours alone would cut both."""
    star, chain = [(1, 2), (3, 4), (5, 1), (5, 2), (5, 3), (5, 4)], [(1, 3), (3, 5), (5, 2)]
    for links in (star, chain):
        sids = sorted({x for pair in links for x in pair})
        sets = {s: list(range(1000 * s, 1000 * s + 40)) for s in sids}
        for k, (a, b) in enumerate(links):  # what a link shares; at this threshold nothing else is linked
            shared = range(10**6 + 1000 * k, 10**6 + 1000 * k + 100)
            sets[a] += shared
            sets[b] += shared
        packed = [np.array(sorted(sets[s]), np.uint64).tobytes() for s in sids]
        counts, edges = jaccard_join._linked(sids, sids, [1] * len(sids), [[7]] * len(sids), packed, 7, 0.12)
        assert list(counts) == [sum(s in pair for pair in links) for s in sids]
        assert len(edges) == len(sids) - 1 and all(tuple(sorted(e)) in {tuple(sorted(x)) for x in links} for e in edges)
        counts, edges = jaccard_join._linked(sids, [0] * len(sids), [1] * len(sids), [[7]] * len(sids), packed, 7, 0.12)
        assert not counts.any() and not edges
        counts, _ = jaccard_join._linked(sids, sids, [1] * len(sids), [[3, 7]] * len(sids), packed, 7, 0.12)
        assert not counts.any()  # counted in the group 3


def test_one_of_each_class_stays_by_row(spark, none):
    """Repeated and null ids: no text is lost that is like no other, and one row of each class stays."""
    near, other = PROSE + " more", " ".join(f"z{k}" for k in range(50))
    rows = [(1, PROSE, "a"), (2, near, "a"), (2, other, "a"), (2, other, "b"), (None, near + " x", "c"), (None, "alone " * 9 + "here", "c"), (7, "", "d"), (7, None, "d"), (8, PROSE, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, th string").withColumn("row", F.lit(1)).withColumn("id", F.lit("x"))
    got = jaccard_join.keep_one_each(df)
    assert got.columns == df.columns and jaccard_join.keep_one_each(none).count() == 0
    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
    assert texts == [(False, 1, PROSE), (False, 2, other), (False, 7, ""), (False, 7, ""), (True, 0, "alone " * 9 + "here")]


def test_jaccard_classes_of_stars(spark):
    """An original and two pairs of edited versions, many times: one class each, whatever ids the sets get."""
    rows = []
    for k in range(25):
        words = [f"s{k}w{i}" for i in range(200)]
        for spots in ((), (10, 30, 50, 70), (10, 30, 50, 71), (110, 130, 150, 170), (110, 130, 150, 171)):
            rows.append((len(rows), " ".join("edited" if i in spots else w for i, w in enumerate(words))))
    got = {r.doc_id: r for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].class_id == i - i % 5 and got[i].links == (2 if i % 5 else 4) for i in got)


def test_permutation_and_shards(spark, docs, none):
    for n in (1, 2, 3, 7, 50, 999):
        got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
        assert sorted(got) == list(range(n))
    got = sharding.shards(docs, count=5).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[4].size == 16 and by[4].text_crc32 == 0 and by[8].text_crc32 == zlib.crc32(b"short text")
    key = lambda rows: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(sharding.shards(docs.repartition(7), count=5).collect())
    assert sharding.shards(none).count() == 0


def plain_permutation(x, n, key):
    """The walk in plain integers, with the columns' public hash."""
    import math
    import struct

    import xxhash

    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))

    def hashed(*values):  # whole numbers of 4 bytes, the last one of 8, seeds chained from 42
        h = 42
        for k, v in enumerate(values):
            h = xxhash.xxh64_intdigest(struct.pack("<q" if k == len(values) - 1 else "<i", v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    while True:
        left, right = divmod(x, b)
        for i in range(16):
            if i % 2 == 0:
                left = (left + hashed(key, i, 0, right) % a) % a
            else:
                right = (right + hashed(key, i, 1, left) % b) % b
        x = left * b + right
        if x < n:
            return x


def test_shards_of_the_table_in_plain_integers(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    order = sorted((r["doc_id"], zlib.crc32((r["text"] or "").encode()), 16 + len((r["text"] or "").encode())) for r in table)
    got = {r.doc_id: r for r in sharding.query(spark, sf_dir).collect()}
    for number, (i, crc, size) in enumerate(order):
        place = plain_permutation(number, len(order), 0)
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (size, crc, "rows", place % 40, place // 40, None)
    big = (1 << 61) + 12345
    far = spark.range(5).select((F.col("id") + big - 7).alias("x")).select("x", sharding.permuted(F.col("x"), big, 3).alias("p")).collect()
    assert all(r.p == plain_permutation(r.x, big, 3) for r in far)


def water(sizes, weights, most=3.0):
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


def test_mixing(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(4000)] + [(5000 + i, "w w w", "e") for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    names = ["a", "b", "c", "d", "e", None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    for n, size, want in zip(names, sizes, water(sizes, [5, 2, 1, 5, 2, 1]), strict=True):
        g = got[got.source.isna() if n is None else got.source == n]
        assert (g.source_size == size).all() and np.allclose(g.target, want) and abs(g.taken.sum() - want) <= max(3, 0.01 * want)
        # Rates by bisection on the tilt.
        mean = g["size"][g["size"] > 0].mean()
        low, high = -200.0, 200.0
        for _ in range(200):
            mid = (low + high) / 2
            r = np.minimum(3, np.exp(np.minimum(mid * g["size"] / mean, 50)))
            low, high = (mid, high) if (r * g["size"]).sum() < want else (low, mid)
        if want < 2.999 * size:
            assert np.allclose(r[g["size"] > 0], g.rate[g["size"] > 0], rtol=1e-4)
    small = mixing.mix(docs).collect()
    assert len(small) == len(ROWS) and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_counts_sources_once(spark, docs, monkeypatch):
    """Each turn's plans, threads and code stay in the driver's memory, so a turn makes few."""
    counted, plans = [], []
    small, save = mixing._small, mixing.Scratch.save
    monkeypatch.setattr(mixing, "_small", lambda df: counted.append(df) or small(df))
    monkeypatch.setattr(mixing.Scratch, "save", lambda self, df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or save(self, df))
    assert mixing.mix(docs).count() == len(ROWS) and len(counted) == 1
    steps = [p for c, p in plans if c[-1] == "off"][1:]
    assert steps and all(p.count("Join ") == 1 for p in steps)


def test_driver_gives_memory_back(spark, docs, monkeypatch):
    """Saving a table gives the driver's free native memory back, though not all the time."""
    given, relieve = [], base.relieve
    monkeypatch.setattr(base, "relieve", lambda s: given.append(relieve(s)))
    monkeypatch.setattr(base, "_relieved", -1e9)
    scratch = base.Scratch(spark)
    for _ in range(2):
        assert scratch.save(docs).count() == len(ROWS)
    assert given[0] and len(given) == 2
    monkeypatch.setattr(base, "RELIEF_S", 1e9)
    assert not relieve(spark)


@pytest.mark.parametrize("share", [10_000, 7])
def test_mixing_of_repeated_rows(spark, monkeypatch, share):
    """Null and repeated ids, alike or not: targets are met, and reruns agree."""
    monkeypatch.setattr(mixing, "SHARE", share)
    rows = [(None, "w " * 8, "a")] * 300 + [(1, "w " * 8, "b")] * 200 + [(2, f"w{k % 3} " * 5, "b") for k in range(300)] + [(k, "w " * 8, "c") for k in range(300)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", rank int, rows int, `key` int")
    got = mixing.mix(df).toPandas()
    for n, want in got.groupby("source").target.first().items():
        assert abs(got[got.source == n].taken.sum() - want) <= max(8, 0.01 * want)
    key = lambda x: sorted(map(str, x.itertuples(index=False, name=None)))
    assert key(got) == key(mixing.mix(df.repartition(5)).toPandas())
    many = mixing.mixed_documents(df)
    assert many.columns == df.columns and many.count() == got.copies.sum()


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files")
def test_pieces(docs):
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())

    def brute(text):
        s = pieces.SPACE + text.replace(" ", pieces.SPACE)
        ends, paths = p.edges(s), [[(0, ())]]
        for j in range(1, len(s) + 1):
            paths.append([(a + w, b + i) for k, w, i in ends[j] for a, b in paths[k]])
        return sorted((a for a, _ in paths[-1]), reverse=True)[:4]

    for text in ("hello", "a  b", " x", "don't.", "éà ,", "\n\na", "中ç", "  ", "the the", "inin enen"):
        got = p.nbest_ids(text)
        assert [a for a, _ in got] == brute(text) and all(p.decode(i) == text for _, i in got)
        assert len({tuple(i) for _, i in got}) == len(got)
    for text in ("a▁b", "▁", "\0 z", "x" * 300, "😀" * 70, "new▁ ▁▁"):
        assert all(p.decode(i) == text for _, i in p.nbest_ids(text))
    rows = pieces.encoded(docs).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows) and all(r.n_pieces == len(r.ids) for r in rows)
    texts = pieces.decoded(pieces.encoded(docs)).select("text").collect()
    assert sorted(r.text for r in texts) == sorted(t or "" for _, t, _ in ROWS)


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files")
def test_pieces_of_all_ranks(spark, docs):
    """The query's rows give every one of the n best, and each decodes to the text."""
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    more = spark.createDataFrame([(20, "the the inin enen 中ç", "d"), (21, "a▁b  new▁ ▁▁ x", "d"), (22, " twice twice", "d")], DOCS)
    rows = pieces.encoded(docs.unionByName(more), keep=("text",))
    for r in rows.collect():
        want = p.nbest_ids(r.text)
        assert [pieces.overlaid(r.ids, c) for c in r.nbest_changes] == [i for _, i in want] and len(r.nbest_scores) == len(want)
    for rank in range(1, 4):
        for r in pieces.decoded(rows, to="again", rank=rank).collect():
            assert r.again == ((r.text or "") if rank < len(r.nbest_scores) else None)


def test_digests(spark, none):
    rows = [(3, "third text " * 30), (1, "first one, " * 40), (2, None), (7, "the last of all " * 20), (7, "tie")]
    got = digests.edits(spark.createDataFrame(rows, "doc_id bigint, text string"), parts=3).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got if r.n_chars != 3}
    assert by[1].edited_sha256 == hashlib.sha256(("first one, " * 20).encode()).hexdigest()
    assert by[2].n_chars == 0 and by[2].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert digests.likeness(by[1].fingerprint, by[1].fingerprint) == 1 and all(0 <= r.near_next <= 1 for r in got)
    one = digests.edits(spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and digests.edits(none).count() == 0
    long = "é long text " * 200_000
    rows = [(1, long, "x"), (None, "no id", "y"), (None, "no id", "y"), (None, "no id either", "z"), (2, "", "w")]
    df = spark.createDataFrame(rows, "doc_id int, text string, fingerprint string")
    for parts in (1, 4, 9):
        got = digests.edits(df.repartition(3), parts=parts).collect()
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint, r.edited_sha256, round(r.near_next, 9))
        seen = sorted(map(key, got)) if parts == 1 else seen
        assert sorted(map(key, got)) == seen and len(got) == 5
    assert digests.fingerprints(df).columns == ["doc_id", "text", "fingerprint"] and len(digests.fingerprints(df).first().fingerprint) == 132
    data, c = bytes(random.Random(5).randrange(256) for _ in range(5000)), digests.counts
    assert c(data).sum() == 6 * (len(data) - 4) and (c(data[:2504]) + c(data[2500:]) == c(data)).all()


def plain_digest(data):
    """The digest by loops over windows, apart from the operator's tables."""
    counts = [0] * 256
    pair = lambda x, y: ((((x << 8 | y) * 0x9E3779B1) & 0xFFFFFFFF) >> 8) & 0xFFFF
    third = lambda z: ((z * 0x85EBCA6B + 0x5BD1E995) >> 7) & 0xFFFF
    for i in range(4, len(data)):
        for salt, (y, z) in enumerate([(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)], 1):
            mixed = (pair(data[i], data[i - y]) ^ third(data[i - z])) * ((2 * salt * 0x2F1B + 1) & 0xFFFF) & 0xFFFF
            counts[mixed >> 8] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    codes = [(x > q1) + (x > q2) + (x > q3) for x in counts]
    body = "".join(f"{a << 6 | b << 4 | c << 2 | d:02x}" for a, b, c, d in zip(*[iter(codes)] * 4, strict=True))
    ratios = (q1 * 16 // q3 % 16, q2 * 16 // q3 % 16) if q3 else (0, 0)
    return f"{min(255, round(8 * np.log2(len(data) + 1))):02x}{ratios[0]:x}{ratios[1]:x}{body}", codes


def test_digests_of_the_table_by_loops(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs_ = sorted((r["doc_id"], r["text"] or "") for r in table)
    got = {r.doc_id: r for r in digests.query(spark, sf_dir).collect()}
    assert len(got) == len(docs_)
    for k, (i, text) in enumerate(docs_):
        following = docs_[(k + 1) % len(docs_)][1]
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        if len(text) > 3000:
            continue  # loops are slow
        (a, x), (b, y) = plain_digest(text.encode()), plain_digest(new.encode())
        assert got[i].fingerprint == a and got[i].edited_fingerprint == b
        body = sum(6 if abs(p - q) == 3 else abs(p - q) for p, q in zip(x, y, strict=True))
        u, v = bytes.fromhex(a[:4]), bytes.fromhex(b[:4])
        length = min(max(0, abs(u[0] - v[0]) - 1) + (u[0] != v[0]) / 12, 8)
        ratios = sum(min(abs(p - q), 8) for p, q in ((u[1] >> 4, v[1] >> 4), (u[1] & 15, v[1] & 15)))
        assert np.isclose(got[i].near_edited, max(0, 1 - (body + round(length * 12) + 2 * ratios) / 416))


def test_urls(spark):
    cases = {
        "https://a.Example.NET/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://xnet/": ("xnet", "/", None, "allow"),
        "http://a.org#f": ("a.org", "", None, "allow"),
        "x.org/fr/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judged(df).collect()} == cases
    assert url_filters.judged(df.limit(0)).count() == 0
    more = df.select("url", F.lit(1).alias("Host"), F.lit(2).alias("rule"))
    assert url_filters.judged(more).columns == ["url", "host", "path", "rule", "verdict"]
    assert url_filters.judged(spark.createDataFrame([("http://net/" + "a" * 1_000_000,)], "url string")).first().verdict == "block"


def test_literals_of_expressions():
    for expression, want in {
        r"^ads\.": ["^ads."], r"/track(?:er)?/[0-9]+/px\.gif$": ["/track", "/", "/px.gif$"], r"a|b": [], r"/x+y?z{2}/end/": ["/x", "/end/"],
        r"/[^/]+/[]]/(a(b)[)]|c)/in/": ["/", "/", "/", "/in/"], r"\d/\w-b\b": ["/", "-b"],
    }.items():
        assert url_filters.literals(expression.replace("\\\\", "\\")) == want
    assert url_filters.Pattern("block", r"/ad/\d+/banner\.gif").tokens == ["ad", "banner"]


def test_many_rules_against_trying_each(spark):
    rng = random.Random(12)
    words = [f"t{k}" for k in range(60)] + ["ads", "track", "x1"]
    word = lambda: rng.choice(words)
    rules = []
    for k in range(1000):
        verdict = rng.choice(["allow", "block"])
        kind = rng.randrange(5)
        if kind < 2:
            rules.append(url_filters.Rule(verdict, f"{word()}.{word()}" if kind else word(), rng.choice(["/", f"/{word()}/", f"/{word()[:2]}"])))
        else:
            expression = [rf"/{word()}/\d+/", rf"^{word()}\.(?:{word()}|{word()})", rf"{word()}[-_]?{word()}/", rf"({word()})+/{word()}$", rf"/{word()}|/{word()}/{word()}", rf"/{word()}-{word()}/?$"][k % 6]
            rules.append(url_filters.Pattern(verdict, expression))
    urls = [f"http://{word()}.{word()}/{word()}{rng.choice(['/', '-', '/7/', ''])}{word()}{rng.choice(['', '/', '?q'])}" for _ in range(400)]
    got = {r.url: (r.rule, r.verdict) for r in url_filters.judged(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    hits = 0
    for u in urls:
        host, path = url_filters.parts(u)
        best = None
        for r in rules:
            if isinstance(r, url_filters.Pattern):
                fits = re.search(r.pattern, f"{host}\n{path}", re.DOTALL)
            else:
                fits = (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
            if fits and (best is None or len(r.name) > len(best.name)):
                best = r
        hits += best is not None
        assert got[u] == ((best.name, best.verdict) if best else (None, "allow")), u
    assert hits > 100


def test_surrogates(spark):
    text = 'Mr. Robert Miller, AB.30@mail1.example.com, +1 (961) 555-6946, 187.87.99.220, 4111111111111111, token = "99168226c4d3cee7e953", Frau Schmidt'
    rows = [(1, text), (2, "ab.30@mail1.example.com again"), (3, None), (4, ""), (5, "plain words, 2024 and 3.5")]
    got = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()}
    new = got[1].text
    assert [e.kind for e in got[1].entities] == ["name_m", "email", "phone", "ip", "card", "secret", "name_f"]
    for s in ("Robert", "Miller", "AB.30@mail1", "961) 555-6946", "187.87.99.220", "4111111111111111", "99168226c4d3cee7e953", "Schmidt"):
        assert s not in new
    assert got[2].text.split(" ")[0] == [x for x in new.split(", ") if "@" in x][0].lower()
    assert got[3].text is None and got[4].text == "" and got[5].text == rows[4][1]
    k = surrogates.Keyed(b"k")
    assert sorted(k.shifted(x, 500, "t") for x in range(500)) == list(range(500)) and all(k.shifted(x, 500, "t") != x for x in range(500))
    assert surrogates.replaced(spark.createDataFrame([], "text string, Entities int"), b"k").columns == ["text", "entities"]
    c = k.surrogate("card", "4111111111111111")
    assert surrogates.luhn_digit(c[:-1]) == c[-1] and c[0] == "4"


def test_surrogates_in_capitals_and_other_spellings(spark):
    text = 'Mr. Robert Miller, AB.30@mail1.example.com, +1 (961) 555-6946, token = "99168226c4d3cee7e953", Frau Schmidt'
    secret = "99168226c4d3cee7e953"
    others = [f'token="{secret}"', f'Token: "{secret}"', f"API_KEY='{secret}'", f'{{"password" : "{secret}"}}', f"secret =\t'{secret}'"]
    rows = [(1, text), (2, text.upper()), *enumerate(others, 3), (9, "I miss London, a key = value and sir names")]
    got = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id bigint, text string"), b"k").collect()}
    assert [e.kind for e in got[2].entities] == [e.kind for e in got[1].entities] == ["name_m", "email", "phone", "secret", "name_f"]
    names = [[r.text.split(", ")[0], r.text.split(", ")[4]] for r in (got[1], got[2])]
    assert [x.upper() for x in names[0]] == names[1] and "MILLER" not in got[2].text and secret.upper() not in got[2].text
    assert all([e.kind for e in got[i].entities] == ["secret"] and secret not in got[i].text for i in range(3, 8))
    assert got[9].text == rows[-1][1] and not got[9].entities


def test_surrogates_never_stay(spark):
    """Letters outside the lists, other scripts, the same person without title, a text of megabytes."""
    texts = ["Mr Ææ came", "用户@mail.cn", "Mr Robert Miller came. Robert Miller left. ROBERT MILLERS", "Mr Żółć and Mrs Ωμέγα", "ÆÆÆ@ŁŁŁ.example.com", "x " * 600_000 + "Mr Robert Miller"]
    got = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), b"k").orderBy("doc_id").collect()]
    assert "Ææ" not in got[0] and "用户" not in got[1] and got[1].endswith(".cn") and "Ż" not in got[3]
    first, rest = got[2].split(" came. ")
    assert "Robert Miller" not in got[2] and rest.startswith(first.removeprefix("Mr ") + " left.") and len(got[4]) == len(texts[4]) and "ÆÆÆ" not in got[4]
    assert got[5][:20] == texts[5][:20] and got[5].split("Mr ")[1] == first.removeprefix("Mr ")


def test_surrogates_are_distinct(spark):
    """Names by construction, within gender and script; what can't change in its format by the check."""
    k = surrogates.Keyed(b"k")
    firsts = [n for p in surrogates.FIRST_NAMES.values() for n in p] + ["Zed", "Quentin", "Ada"]
    names = [f"{a} {b}" for a in firsts for b in ("Miller", "Kohler", "Иванов", "Żak")] + ["Miller", "Mary", "James"]
    dealt = [k.surrogate("name_m", n) for n in names]
    assert len(set(dealt)) == len(names) and all(a != b for a, b in zip(names, dealt, strict=True))
    genders = {n: g for (g, _), p in surrogates.FIRST_NAMES.items() for n in p}
    assert all(genders.get(a.split(" ")[0]) == genders.get(b.split(" ")[0]) for a, b in zip(names, dealt, strict=True) if " " in a)
    # Without a letter or digit nothing can change in the format: these are found by the check and drawn anew.
    secrets = ["_" * 16, "-" * 16, "_-" * 8]
    df = spark.createDataFrame([(f'token="{x}"',) for x in secrets] * 2, "text string")
    odd = surrogates.exceptions(df, b"k")
    out = [k.surrogate("secret", x, odd[("secret", x)]) for x in secrets]
    assert len(set(out)) == 3 and not set(out) & set(secrets)
    got = {r.text for r in surrogates.replaced(df, b"k").collect()}
    assert got == {f'token="{x}"' for x in out}


def test_licenses(spark):
    rows = [(1, "Some words.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0."), (3, "The driver showed a license at the border."), (4, None), (5, ""), (6, "All rights reserved.\nmore")]
    got = {r.doc_id: [(x.line, x.family, x.confirmed) for x in r.licenses] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    notice = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files, to deal in the\nSoftware without restriction."
    more = spark.createDataFrame([(1, f"prose\n\n{notice}\n\nmore prose", 0), (2, "w " * 500_000 + "\nAll rights reserved.", 0), (2, "x", 0)], "id int, text string, LICENSES int")
    found = licenses.scanned(more)
    assert found.columns == ["id", "text", "licenses"] and licenses.scanned(more.limit(0)).count() == 0
    by = sorted((r.id, [(x.line, x.family, x.confirmed) for x in r.licenses]) for r in found.collect())
    assert by == [(1, [(2, "mit", True)]), (2, []), (2, [(1, "proprietary", True)])]
    assert got == {1: [(1, "mit", True)], 2: [(0, "cc-by-nc", True)], 3: [], 4: [], 5: [], 6: [(0, "proprietary", True)]}


def test_toxicity(spark, docs):
    rng = random.Random(6)
    plain = [f"w{k}" for k in range(80)]

    def made(bad):
        return " ".join(rng.choice(plain) for _ in range(60)) + "".join(f" {rng.choice(['scumx', 'scumy', 'vile'])}" for _ in range(bad))

    train = [(made(0), 0) for _ in range(200)] + [(made(1 + k % 9), 1) for k in range(100)]
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    assert list(model.thresholds) == sorted(model.thresholds)
    lookup = toxicity._Lookup(model.features)
    p = model.grades(model.scores([made(0) for _ in range(50)] + [made(k) for k in (1, 4, 9) for _ in range(20)], lookup))
    assert np.allclose(p.sum(axis=1), 1) and (p[:50, 0] > 0.5).all() and (p[50:, 0] < 0.5).mean() > 0.95
    severity = (p @ np.arange(4))[50:].reshape(3, 20).mean(axis=1)
    assert severity[0] < severity[1] < severity[2]
    got = toxicity.graded(docs, model).collect()
    assert len(got) == len(ROWS) and all(r.p_toxic < 0.5 for r in got)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.clean_documents(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == len(ROWS) and not none.features


def plain_p_toxic(model, text):
    """The chance of any toxic grade, by plain loops over the exported weights."""
    counts = {}
    for word in re.findall(r"\w+", (text or "").lower()):
        for feature in [word] + ["^" + word[:k] for k in (4, 5, 6, 7, 8) if k <= len(word)]:
            if feature in model.features:
                counts[feature] = counts.get(feature, 0) + 1
    score = sum(model.weights[model.features[f]] * math.log(1 + c) for f, c in counts.items())
    return 1 - 1 / (1 + math.exp(score - model.thresholds[0]))


def labelled_texts(rng, n):
    """Texts of plain words, a third of them with some marker words, and their labels."""
    out = []
    for k in range(n):
        bad = (k % 3 == 0) * rng.randrange(1, 9)
        ws = [f"w{rng.randrange(90)}" for _ in range(60)] + [rng.choice(["scumx", "scumy", "viler"]) for _ in range(bad)]
        rng.shuffle(ws)
        out.append((" ".join(ws), int(bad > 0)))
    return out


def test_toxicity_by_plain_loops(spark):
    """The fit is a minimum of the loss, scores are those of plain loops, unseen texts are told apart, odd rows get a grade."""
    rng = random.Random(8)
    seen, unseen = labelled_texts(rng, 450), labelled_texts(rng, 300)
    model = toxicity.fit([t for t, _ in seen], [y for _, y in seen])
    odd = [None, "", "scumx", "x " * 500_000 + "scumx scumy " * 5]
    rows = [(k, t, "kept") for k, t in enumerate([t for t, _ in unseen] + odd)] * 2
    got = toxicity.graded(spark.createDataFrame(rows, "doc_id int, text string, GRADE string"), model)
    assert got.columns == ["doc_id", "text", "severity", "grade", "p_toxic"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        assert by.setdefault(r.doc_id, (r.severity, r.grade, r.p_toxic)) == (r.severity, r.grade, r.p_toxic)
        assert abs(r.p_toxic - plain_p_toxic(model, r.text)) < 1e-9 and 0 <= r.severity <= 3
    caught = [(by[k][2] >= 0.5) == bool(y) for k, (_, y) in enumerate(unseen)]
    assert sum(caught) >= 0.97 * len(caught) and by[len(unseen)] == by[len(unseen) + 1] and by[len(unseen) + 3][2] > 0.5
    assert toxicity.graded(got.limit(0), model).count() == 0


def test_toxicity_samples_documents_once(spark, monkeypatch):
    """Rows that repeat an id count once, labels that repeat too; what's sampled doesn't depend on the partitions."""
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 3, 0: 4})
    docs = spark.createDataFrame([(k % 20, f"Word{k % 40} word x X") for k in range(400)] + [(None, "no id"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3 + [(None, 1)], "doc_id bigint, toxic int")
    got, again = toxicity.sample(docs, labels), toxicity.sample(docs.repartition(7), labels)
    listed = lambda c: [(y, dict(zip(k.tolist(), n.tolist(), strict=True))) for y, (k, n) in zip(c.toxic, c.rows, strict=True)]
    assert sorted(got.toxic) == [0] * 4 + [1] * 3 and listed(got) == listed(again) and got.numbers == again.numbers
    assert all(c == {} or sorted(c.values()) == [1, 1, 2] for _, c in listed(got))


#: Columns of the same names as the operators' own results and helpers, besides those of documents.
CLASHING = ("severity", "grade", "keep_id", "kept", "row", "n", "f1", "class_id", "root", "size", "copies", "rate", "ids", "score", "others", "hash")


def odd_documents(rng):
    rows = [(k, t, "en", f"s{k % 3}") for k, (t, _) in enumerate(labelled_texts(rng, 90))]
    base = [f"t{rng.randrange(500)}" for _ in range(150)]
    near = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(0, 150, 15)]
    rows += [(100 + k, t, None, "s1") for k, t in enumerate(near)]
    rows += [(200, PROSE, "en", None), (201, PROSE + "\n", "en", "s0"), (202, PROSE.replace(" ", "  "), "de", "s0"), (202, "another text with the same id as a copy", "de", "s0"), (203, "a text without a source " * 20, "en", None)]
    rows += [(300, None, None, None), (301, "", "fr", "s2"), (302, " \t", "fr", "s2"), (None, "a text without an id", "en", "s2"), (None, "another text without an id", "en", "s2")]
    rows += [(400, "long " + " ".join(f"v{k}" for k in range(100_000)), "en", "s3")] * 3
    return rows


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage on all the one before kept, with nulls, repeats, a long text and clashing columns."""
    import corpus_pipeline

    rng = random.Random(9)
    rows = odd_documents(rng)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    stages, now = dict(corpus_pipeline.STAGES), docs

    def step(name):
        path = f"{tmp_path}/{name}.parquet"
        stages[name](spark, now, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in out.collect() for c in CLASHING)
        return out

    def pairs(df):
        return sorted([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], key=str)

    now = step("toxicity")
    clean = [r for r in rows if plain_p_toxic(model, r[1]) < 0.5]
    assert pairs(now) == sorted([r[:2] for r in clean], key=str) and len(rows) - len(clean) >= 28

    now = step("exact_dedup")
    groups = {}
    for i, t, *_ in clean:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t))
    single = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0])) for g in groups.values()]
    assert pairs(now) == sorted(single, key=str)

    now = step("near_dedup")
    single.sort(key=lambda r: (r[0] is None, r[0] or 0))  # the least id of a class stays
    root = components_of([t for _, t in single])
    kept = [r for k, r in enumerate(single) if root[k] == k]
    assert pairs(now) == sorted(kept, key=str) and len(single) - len(kept) == 9

    before = {(r.doc_id, r.text): r for r in now.collect()}
    now = step("mixing")
    got = now.collect()
    assert all(r == before[(r.doc_id, r.text)] for r in got)
    names = [*sorted({r.source for r in before.values() if r.source}), None]
    size = {k: len((r.text or "").split()) for k, r in before.items()}
    sizes = [[size[k] for k, r in before.items() if r.source == n] for n in names]
    for n, own, want in zip(names, sizes, water(list(map(sum, sizes)), [5, 2, 1, 5, 2, 1][: len(names)]), strict=True):
        assert abs(sum(size[(r.doc_id, r.text)] for r in got if r.source == n) - want) <= max(own), n
    copies = {}
    for r in got:
        copies[(r.doc_id, r.text)] = copies.get((r.doc_id, r.text), 0) + 1
    assert max(copies.values()) <= 3 and all(copies.get((i, t)) == 1 for i, t in kept if not (t or "").split())

    now = step("sentencepiece")
    assert sorted([(r.doc_id, r.text or "") for r in pieces.decoded(now).collect()], key=str) == sorted([(r.doc_id, r.text or "") for r in got], key=str)
    assert now.where("not round_trip").isEmpty()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == now.columns and sorted(map(str, whole.collect())) == sorted(map(str, now.collect()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.where("not round_trip").isEmpty()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf_dir).toPandas(), c.sql(queries.ORACLES[name]).df()
    key = lambda x: sorted(map(str, x[sorted(x)].fillna("~").itertuples(index=False, name=None)))
    assert key(a) == key(b)
