"""Statistics, matching, rewriting, labelling, smoothing, rendering, clean-up, sources."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from anchorage.operators import annotate, dataset, links, markup, match, ordering, rewrite
from anchorage.sources import dump


def test_statistics(spark):
    counts = spark.createDataFrame([("a", 48), ("b", 60), ("c", 1)], "anchor string, freq_link long")
    plain = spark.createDataFrame([("a", 2), ("c", 99)], "anchor string, freq_text long")
    stats = links.surface_stats(counts, plain)
    assert {r.anchor: (r.freq_text, r.total) for r in stats.collect()} == {"a": (2, 50), "b": (0, 60), "c": (99, 100)}
    assert [r.anchor for r in links.blacklist(stats).collect()] == ["c"]
    pairs = spark.createDataFrame([("b", "T", 59), ("b", "U", 1)], "anchor string, target string, pair_count long")
    white = links.whitelist(stats, links.top_targets(pairs)).collect()
    assert [(r.anchor, r.target) for r in white] == [("b", "T")] and math.isclose(white[0].target_share, 59 / 60)


def test_matching_against_all_positions(spark):
    patterns, text = ["he", "she", "hers", "e", "a b", "b,", "l'eau"], "ushers he, she a b, a b l'eau\nhers"

    def word(c):
        return c.isalnum() or c == "_"

    want = {}
    for p in patterns:
        for i in range(len(text)):
            if text.startswith(p, i):
                j = i + len(p)
                if word(p[0]) and word(p[-1]) and (i and word(text[i - 1]) or j < len(text) and word(text[j])):
                    continue
                want[p] = want.get(p, 0) + 1
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    pat = spark.createDataFrame([(p,) for p in patterns], "anchor string")
    assert {r.anchor: r.freq_text for r in match.plain_counts(df, pat).collect()} == want
    joined = {r.anchor: r.freq_text for r in match.plain_counts_by_join(df, pat).collect()}
    assert joined == {k: v for k, v in want.items() if k != "b,"}
    assert match.plain_counts(df, pat.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2, 4])
def test_matching_in_blocks(spark, monkeypatch, most):
    """More patterns than the bound, some of many words and some without word boundaries."""
    monkeypatch.setattr(match, "MOST_PATTERNS", most)
    df = spark.createDataFrame([("C++ and one two three four five six at Inc. one",), ("Inc. C++",)], "text string")
    want = {"C++": 2, "Inc.": 2, "one two three four five six": 1, "one": 2}
    pat = spark.createDataFrame([(p,) for p in [*want, "none"]], "anchor string")
    assert {r.anchor: r.freq_text for r in match.plain_counts(df, pat).collect()} == want
    joined = {r.anchor: r.freq_text for r in match.plain_counts_by_join(df, pat).collect()}
    assert joined == {"one two three four five six": 1, "one": 2}


def test_rewriting(spark):
    assert rewrite.unlinked("[[T|a]] [[b]] [[|a]] [[a", frozenset(["a"])) == "a [[b]] [[|a]] [[a"
    m = match.Matcher(["ab", "ab cd", "cd", "[["])
    assert rewrite.autolinked("ab cd [[ab]] xab cd", m, ["1", "2", "3", "4"]) == "[[2|ab cd]] [[ab]] xab [[3|cd]]"
    assert rewrite.autolinked("ab", match.Matcher([]), []) == "ab"
    docs = spark.createDataFrame([(1, "[[a]] b\n\nc d e"), (2, "x"), (3, None)], "id int, text string")
    got = rewrite.filtered(docs, keep=("id",)).collect()
    assert [(r.id, r.text, r.link_ratio) for r in got] == [(1, "[[a]] b", 0.5)]


def test_segments_and_tags(spark):
    text = "Le [[Paris|grand Paris]] et [[Lyon]][[Nice]] bleu."
    df = spark.createDataFrame([(1, text), (2, "[[a|b|c]]"), (3, None)], "id int, text string")
    r = dataset.labelled(df, max_length=None, keep=("id",)).collect()
    assert [x.id for x in r] == [1] and r[0].output == [-100, 0, 1, 2, 0, 1, 0, 0, -100]
    segs = df.where("id = 1").select(dataset.segments(F.col("text")).alias("s"), dataset.strip_markup(F.col("text")).alias("raw")).first()
    assert segs.raw == "Le grand Paris et LyonNice bleu." and [(s.start, s.end) for s in segs.s if s.in_link] == [(3, 14), (18, 22), (22, 26)]
    padded = dataset.labelled(df, max_length=8, keep=("id",)).first()
    assert len(padded.output) == 8 and padded.output[-1] == -100
    weights = dataset.class_weights(dataset.label_histogram(dataset.labelled(df, keep=("id",)))).collect()
    assert {w.label: w.weight for w in weights} == {0: 1.0, 1: 2.0, 2: 4.0}


def test_smoothing_equals_the_loop(spark):
    rows = [list(x) for n in range(7) for x in itertools.product((0, 1, 2), repeat=n)]
    got = spark.createDataFrame([(r,) for r in rows], "x array<int>").select("x", annotate.smoothed(F.col("x")).alias("y")).collect()
    assert all(r.y == annotate.smooth_list(r.x) for r in got)


def test_rendering():
    text = "né à Trèves en Prusse"
    spans = [(0, 0), (0, 2), (3, 4), (5, 11), (12, 14), (15, 21), (0, 0)]
    assert annotate.rendered(text, spans, annotate.smooth_list([0, 0, 0, 1, 0, 1, 0])) == f'né à <a href="{annotate.SEARCH}Tr%C3%A8ves%20en%20Prusse" >Trèves en Prusse</a>'
    assert annotate.rendered(text, spans, annotate.smooth_list([0, 0, 0, 1, 0, 0, 0])) == text
    assert annotate.rendered(text, spans, [0, 0, 0, 1, 2, 0, 0]) == f'né à <a href="{annotate.SEARCH}Tr%C3%A8ves%20en%20" >Trèves en </a>Prusse'


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_sizes(spark, n):
    rows = dataset.split(spark.range(n).withColumnRenamed("id", "k"), "k").groupBy("part").count().collect()
    got = {r.part: r["count"] for r in rows}
    test = math.ceil(0.2 * n)
    dev = math.ceil(0.1 * (n - test))
    assert got == {k: v for k, v in (("test", test), ("dev", dev), ("train", n - test - dev)) if v}


def test_ranks_with_far_and_frequent_values(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    values = [None] * 900 + [7] * 3000 + list(range(3000)) + [low, low, high, high, high - 1] + [1 << 52] * 500
    rows = [(v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "v bigint, i int")
    got = ordering.ranked(df.repartition(7), "v").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(len(values)))
    assert [r.v for r in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    assert got == ordering.ranked(df, "v").orderBy("rank").collect()
    sizes = [r._n for r in ordering.bucketed(df, "v", F.xxhash64("i")).select("_b", "_n").distinct().collect()]
    assert max(sizes) < 100 and sum(sizes) == len(values)
    assert ordering.ranked(df.limit(0), "v").count() == 0 and ordering.ranked(df.where("v is null"), "v").count() == 900


def test_markup():
    clean = markup.clean_markup
    assert clean("a<!-- x -->b <ref>no</ref><b>c</b><br>d <table><tr><td>z</td></tr></table>") == "ab c\nd"
    assert clean("{{Infobox|a={{b|c}}}}'''Chiba''' {{japonais|Chiba|x}} {{lang|ja|千}}{{langue|en|two}} {{formatnum:123}}") == "Chiba Chiba two 123"
    assert clean("[[Fichier:x.jpg|thumb|une [[ville]]]]A [[B|c]] [[:Catégorie:D]] [http://x.y nom] [http://x.y] http://bare.org/z") == "A [[B|c]] [[:Catégorie:D]] nom"
    assert clean("== T ==\n* un\n# deux\n----\n{| x\n{| y |}\n|}\n__TOC__ &nbsp;fin&eacute; &#12;") == "un\ndeux\n\nfin"
    assert clean("est une ville.", "Lyon (Rhône)") == "Lyon est une ville."
    assert clean("") == ""


def test_dump(spark, tmp_path):
    import bz2

    def page(i, ns, text):
        return f"<page><title>T{i}</title><ns>{ns}</ns><id>{i}</id><revision><text bytes='1'>{text}</text></revision></page>"

    xml = "<mediawiki>" + page(1, 0, "'''un''' [[deux]]") + page(2, 0, "#REDIRECTION [[A]]") + page(3, 4, "x") + page(4, 0, "") + page(5, 0, " #REDIRECT [[A]]") + "</mediawiki>"
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    pages = dump.read_dump(spark, str(tmp_path / "d.xml.bz2"), 2).cache()
    assert sorted(r.page_id for r in pages.collect()) == [1, 2, 4, 5]
    assert tuple(dump.counters(pages).first()) == (4, 1, 1, 0, 2)
    good, bad = dump.extract(pages)
    assert {r.title: r.text for r in good.collect()}["T1"] == "un [[deux]]" and dump.log_errors(bad) == 0
    dump.write_shards(good, str(tmp_path / "s"))
    again = dump.read_shards(spark, str(tmp_path / "s"))
    assert dump.articles(pages, dump.done_titles(spark, str(tmp_path / "s"))).count() == 0 and again.count() == 2
    with pytest.raises(FileNotFoundError):
        dump.read_shards(spark, str(tmp_path / "s"), "other_*.parquet")
    assert dump.write_shards(again, str(tmp_path / "s"))[0] >= 1
    names = sorted(p.name for p in (tmp_path / "s").glob("*.parquet"))
    assert names == [f"wiki_shard_{k:05d}.parquet" for k in range(len(names))] and dump.read_shards(spark, str(tmp_path / "s")).count() == 4
    rows = dataset.labelled(spark.createDataFrame([('a "q"\n[[b]]',)], "text string"), max_length=4)
    dump.write_dataset(rows, str(tmp_path / "p"), str(tmp_path / "c"))
    assert dump.read_dataset_csv(spark, str(tmp_path / "c")).collect() == rows.collect() == dump.read_dataset(spark, str(tmp_path / "p")).collect()
    assert [dump.format_size(x) for x in (0, 1023, 1024, 3 << 20, 5 * 1024**5, 1024**6)] == ["0.0 B", "1023.0 B", "1.0 KB", "3.0 MB", "5.0 PB", "1024.0 PB"]
    assert dump.format_duration(3661.9) == "01:01:01" and dump.format_duration(360_000) == "100:00:00"


def test_programs(spark, tmp_path):
    """A dump to shards, in two runs, and shards to the rewritten corpus."""
    from anchorage.plans import programs

    texts = ["[[Paris|la ville]] et [[Lyon]] ou Lyon.", "Une [[Lyon]] et Lyon, [[Lyon]] Lyon Lyon", "#REDIRECT [[x]]", "", "x [[Paris|la ville]], la ville."]
    pages = "".join(f"<page><title>T{i}</title><ns>0</ns><id>{i}</id><revision><text>{x}</text></revision></page>" for i, x in enumerate(texts))
    (tmp_path / "d.xml").write_text(f"<mediawiki>{pages}</mediawiki>")
    shards = str(tmp_path / "shards")
    one = programs.extract(spark, str(tmp_path / "d.xml"), shards, limit=1, partitions=2)
    two = programs.extract(spark, str(tmp_path / "d.xml"), shards, partitions=2)
    assert (one["pages"], one["redirects"], one["empty"], one["cleaned"], one["errors"]) == (5, 1, 1, 1, 0)
    assert (two["already_done"], two["to_clean"], two["cleaned"]) == (1, 2, 2) and two["bytes"] > 0
    assert programs.extract(spark, str(tmp_path / "d.xml"), shards)["cleaned"] == 0
    out = programs.build(spark, shards, str(tmp_path / "work"), str(tmp_path / "out"), min_total=1, min_link_for_plain_count=1, whitelist_p=0.3, whitelist_min_total=2, whitelist_target_share=0.5, blacklist_p=0.01)
    stats = {r.anchor: (r.freq_link, r.freq_text) for r in out["surface_stats"].collect()}
    assert stats == {"la ville": (2, 1), "Lyon": (3, 4)} and {r.anchor: r.target for r in out["whitelist"].collect()} == {"la ville": "Paris", "Lyon": "Lyon"}
    got = {r.title: r.text for r in out["articles"].collect()}
    assert got["T0"] == "[[Paris|la ville]] et [[Lyon]] ou [[Lyon|Lyon]]." and got["T4"] == "x [[Paris|la ville]], [[Paris|la ville]]."
    assert {r.file for r in out["articles"].select("file").collect()} <= {p.stem for p in (tmp_path / "shards").glob("wiki_shard_*")}


def test_stream(spark, tmp_path):
    from anchorage.streaming import clean_stream

    spark.createDataFrame([(1, "A", "''x''"), (2, "B", "#redirect [[A]]")], "page_id long, title string, text string").write.parquet(str(tmp_path / "in"))
    clean_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", "x")]
