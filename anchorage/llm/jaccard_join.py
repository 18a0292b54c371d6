"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles. Texts with the same set are one node. A run starts
with all nodes at its root; a tree node picks one or two of the sketch's coordinates by its own
hash, and each set goes to the children named by its min-hash tokens there, so that sets go on
together along shared tokens only. Buckets of at most ``LEAF`` sets, or at the last depth, are
compared by brute force on whole shingle sets; runs are repeated until the chance to miss a pair
at the threshold is below ``1 - recall``.

What is still large at the last depth is never compared with itself as a whole. First each such
bucket is dealt into blocks, a set into one of them, and the links found there join sets into
classes. A bucket that lies in one class is done: another link of its sets could not change the
result. In the others only pairs of different classes are open: a few sets outside the largest
class meet that class's blocks. Where they are many, the bucket is split along further shared tokens as long as that
leaves fewer pairs; sets that stay together are compared by pairs of blocks, a row a block
(``_across``). Rows grow with the sets, not with pairs of them. The links of these classes are
counted at last, over all pairs of a class (``_all_links``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, bits_for, documents, in_bitmap, key_bitmap, mix64, tidy

WORD = re.compile(r"\w+")
WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Min-hash coordinates of a sketch, chance of a node's second coordinate, depth, sets in a leaf.
COORDINATES, SECOND, DEPTH, LEAF = 64, 0.25, 4, 64
#: Sets in a block, and the most sets outside a bucket's largest class that meet all of its blocks.
BLOCK, FEW = 512, 256
#: Bytes of the differences in a block of sets that are counted as a whole.
BLOCK_BYTES = 1 << 22
#: Depth to which large buckets of several classes are split, always by two coordinates a node.
DEEPEST = 16
#: The chance at which the sketch may hide a pair at the threshold from the comparison.
HIDDEN = 1e-8
#: Times the usual bits of a bitmap that picks texts: each one picked in vain moves a whole shingle set.
SPARSE = 8


def survival(depth: int, similarity: float = THRESHOLD, deepest: int = DEEPEST) -> float:
    """The chance that a pair whose sketches agree in this share of coordinates is still together
    after this depth of one run and, should its bucket be large, down to the deepest level."""
    q = 1.0
    for _ in range(depth, deepest):
        q = 1 - (1 - similarity * q) ** 2
    for _ in range(depth):
        q = 1 - (1 - similarity * q) * (1 - SECOND * similarity * q)
    return q


def _agreements(similarity: float) -> list[float]:
    """The chance of each number of equal coordinates."""
    return [math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)]


def runs_for(recall: float, similarity: float = THRESHOLD) -> int:
    """Runs until a pair is missed with a chance of at most ``1 - recall``.

    Runs share the sketch's coordinates, so the chance is averaged over how many of them agree.
    """
    spread = _agreements(similarity)
    alone = [1 - survival(DEPTH, k / COORDINATES) for k in range(COORDINATES + 1)]
    runs = 1
    while sum(p * m**runs for p, m in zip(spread, alone, strict=True)) > 1 - recall:
        runs += 1
    return runs


def screen_for(similarity: float) -> int:
    """Equal coordinates below which a pair is not compared: one at the threshold has fewer with a chance of at most HIDDEN."""
    below, k = 0.0, 0
    for k, p in enumerate(_agreements(similarity)):
        if below + p > HIDDEN:
            break
        below += p
    return k


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; one of all words if there are fewer."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


_odd = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(x: np.ndarray) -> np.ndarray:
    """One 32-bit min-hash token a coordinate; in blocks, so memory stays bounded."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096]
        y = y ^ (y >> np.uint64(32))
        low = np.minimum(low, (_odd[:, None] * y[None, :]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set."""
    d = xxhash.xxh3_128_digest(x.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c, n, mh = [], [], [], []
        for t in b.column("text"):
            x = shingles(t.as_py())
            s = _signature(x)
            a.append(s[0])
            c.append(s[1])
            n.append(len(x))
            mh.append(sketch(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(mh, pa.binary())], ["id", "th", "sa", "sb", "n", "mh"])


def _token(i: Column) -> Column:
    """The i-th token of a sketch, as a binary of four bytes."""
    return F.substring(F.col("mh"), i * 4 + 1, F.lit(4))


def _children(rows: DataFrame, second: float = SECOND) -> DataFrame:
    """Deals each (path, set) to the children of its path; other columns stay."""
    one = F.pmod(F.xxhash64(F.lit(1), "path"), F.lit(COORDINATES))
    two = F.pmod(F.xxhash64(F.lit(2), "path"), F.lit(COORDINATES))
    twice = F.pmod(F.xxhash64(F.lit(3), "path"), F.lit(1000)) < int(1000 * second)
    picks = F.when(twice, F.array(one, two)).otherwise(F.array(one))
    child = F.transform(F.array_distinct(picks), lambda i: F.xxhash64(F.col("path"), i, _token(i.cast("int"))))
    return rows.select(*[c for c in rows.columns if c != "path"], F.explode(child).alias("path"))


def _among(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits, b.column("key").to_numpy(zero_copy_only=False))))

    return run


def _sketches_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sid, mh`` of the sets in rows, and of few others: what a join with rows has to move."""
    key = F.xxhash64("sid")
    bitmap = nodes.sparkSession.sparkContext.broadcast(key_bitmap(rows, key, bits_for(rows.count())).tobytes())
    keyed = nodes.select("sid", "mh", key.alias("key"))
    return keyed.mapInArrow(tidy(_among(bitmap)), keyed.schema).drop("key")


def _leaves(nodes: DataFrame, scratch: Scratch, runs: int) -> DataFrame:
    """``path, sid, size``: all buckets of two and more sets that are to be compared."""
    roots = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(F.lit(7), r))
    rows = nodes.where("n > 0").select("sid", "mh", F.explode(roots).alias("path"))
    out, spent = [], []
    for depth in range(1, DEPTH + 1):
        dealt = _children(rows)
        sizes = dealt.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        if depth in (1, DEPTH):  # sketches stay where they are until a bucket has to be split, and at the last depth
            dealt = dealt.select("sid", "path")
        thin = scratch.save(dealt.join(sizes, "path"))
        spent.append(thin)
        out.append(thin.where(F.col("size") <= LEAF if depth < DEPTH else F.lit(True)).select("path", "sid"))
        large = thin.where(F.col("size") > LEAF).drop("size")
        if depth == DEPTH or large.isEmpty():
            break
        rows = large.join(_sketches_of(large, nodes), "sid") if depth == 1 else large
    leaves = out[0]
    for x in out[1:]:
        leaves = leaves.unionByName(x)
    # Of buckets with the same members one is enough: two sums of hashes name the members.
    named = leaves.groupBy("path").agg(
        F.count("*").alias("size"),
        F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("m1"),
        F.sum(F.xxhash64(F.lit(1), "sid").cast("decimal(38,0)")).alias("m2"),
    )
    kept = named.groupBy("size", "m1", "m2").agg(F.min("path").alias("path")).select("path", "size")
    done = scratch.save(leaves.join(kept, "path"))
    scratch.drop(*spent)
    return done


def _wanted_shingles(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            b = b.filter(pa.array(in_bitmap(bits, b.column("th").to_numpy(zero_copy_only=False))))
            for i in range(0, len(b), 256):
                sa, sb, packed = [], [], []
                for t in b.column("text").slice(i, 256):
                    x = shingles(t.as_py())
                    s = _signature(x)
                    sa.append(s[0])
                    sb.append(s[1])
                    packed.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(packed, pa.binary())], ["sa", "sb", "shingles"])

    return run


def overlaps(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of ``sets[:cut]`` with all sets, exactly.

    Shingles of one set only can't add to them; the rest go through matrix products by columns.
    """
    out = np.zeros((cut, len(sets)), np.float32)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(every)])
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    multiple = np.repeat(counts > 1, counts)
    column, who = column[multiple], who[multiple]
    if not len(column):
        return out
    # Where few rows of the incidence matrix are set, pairs of a column are cheaper than products.
    per = np.bincount(column)
    if float((per.astype(np.float64) ** 2).sum()) < 0.02 * len(per) * cut * len(sets):
        at = np.r_[0, np.cumsum(per)]
        for size in np.unique(per):
            first = at[:-1][per == size]
            members = who[first[:, None] + np.arange(size)[None, :]]
            a, b = np.broadcast_arrays(members[:, :, None], members[:, None, :])
            hit = a < cut
            np.add.at(out, (a[hit], b[hit]), 1)
        return out
    step = max(256, (1 << 24) // max(1, len(sets)) // 4)
    for c in range(0, int(column[-1]) + 1, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - c)), np.float32)
        m[who[lo:hi], column[lo:hi] - c] = 1
        out += m[:cut] @ m.T
    return out


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Runs of rows of one group, the first column; at most a block each."""
    group: list[tuple] = []
    for b in batches:
        for at in range(0, len(b), 1024):
            for row in zip(*[b.column(c).slice(at, 1024).to_pylist() for c in columns], strict=True):
                if group and group[-1][0] != row[0]:
                    yield group
                    group = []
                group.append(row)
    if group:
        yield group


def _first(gids, gid: int) -> np.ndarray:
    """For each two sets by the groups they lie in, whether this group is the least that they share."""
    before = [[g for g in x if g < gid] for x in gids]
    columns = {g: k for k, g in enumerate(sorted({g for x in before for g in x}))}
    earlier = np.zeros((len(before), max(1, len(columns))), np.float32)
    for i, x in enumerate(before):
        earlier[i, [columns[g] for g in x]] = 1
    return earlier @ earlier.T < 0.5


def _alike(sketches: list[bytes]) -> np.ndarray:
    """Equal coordinates of each two sketches."""
    mh = np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint32).reshape(len(sketches), -1).T)
    like = np.zeros((len(sketches), len(sketches)), np.uint8)
    for k in range(len(mh)):
        like += mh[k][:, None] == mh[k][None, :]
    return like


def _screen(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group the sets whose sketch is like that of a set of another class there, with which
        they share no group before: ``gid, sid, root``."""
        for group in _groups(batches, ("gid", "sid", "root", "mh", "gids")):
            if len(group) < 2:
                continue
            sids, roots = (np.array([g[k] for g in group], np.int64) for k in (1, 2))
            near = (_alike([g[3] for g in group]) >= least) & (roots[:, None] != roots[None, :])
            at = np.flatnonzero(near.any(axis=1))
            if len(at):
                at = at[(near[np.ix_(at, at)] & _first([group[i][4] for i in at], group[0][0])).any(axis=1)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group[0][0])), pa.array(sids[at]), pa.array(roots[at])], ["gid", "sid", "root"])

    return run


def _by_group(rows: DataFrame) -> DataFrame:
    """The rows group after group."""
    return rows.repartition("gid").sortWithinPartitions("gid")


def forest(linked: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all that the links and the known connections connect; of each turn of a breadth-first search."""
    near, seen, out = linked | known, np.zeros(len(linked), bool), []
    for start in np.flatnonzero(linked.any(axis=1)):
        queue = [] if seen[start] else [start]
        seen[start] = True
        while queue:
            x = queue.pop()
            new = np.flatnonzero(near[x] & ~seen)
            seen[new] = True
            out += [(int(x), int(y)) for y in new if not known[x, y]]
            queue.extend(new)
    return out


def _linked(sids, roots, copies, gids, packed, gid: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each set's linked documents in a group, and links that connect what is linked there.

    Pairs of one class are not looked at. A pair that shares several groups counts in the least of them.
    """
    sets = [np.frombuffer(x, np.uint64) for x in packed]
    both = overlaps(sets, len(sets))
    n = np.array([len(x) for x in sets], np.float64)
    roots = np.asarray(roots, np.int64)
    known = roots[:, None] == roots[None, :]
    hit = (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9) & ~known
    first = hit & _first(gids, gid)
    return first @ np.asarray(copies, np.int64), [(sids[x], sids[y]) for x, y in forest(hit, known)]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``a, b, links``: a link of a and b, or, with b null, how many documents a is linked with in a group."""
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "links"])

        for group in _groups(batches, ("gid", "sid", "root", "copies", "gids", "shingles")):
            if len(group) > 1:
                sids, roots, copies, gids, packed = zip(*[g[1:] for g in group], strict=True)
                counts, edges = _linked(sids, roots, copies, gids, packed, group[0][0], threshold)
                out.extend((s, None, int(c)) for s, c in zip(sids, counts, strict=True) if c)
                out.extend((x, y, 0) for x, y in edges)
            if len(out) > 10_000:
                yield flush()
        yield flush()

    return run


def _whole(met: DataFrame, texts: DataFrame) -> DataFrame:
    """met with each set's ``shingles``, in place of ``sa, sb, th``; a set may have several rows."""
    bitmap = met.sparkSession.sparkContext.broadcast(key_bitmap(met, F.col("th"), bits_for(SPARSE * met.count())).tobytes())
    whole = texts.mapInArrow(tidy(_wanted_shingles(bitmap)), "sa bigint, sb bigint, shingles binary")
    whole = whole.groupBy("sa", "sb").agg(F.any_value("shingles").alias("shingles"))
    return met.join(whole, ["sa", "sb"]).drop("sa", "sb", "th")


def _found(groups: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float, counted: bool) -> DataFrame:
    """``a, b, links`` of groups ``gid, sid, root``, as ``_compare`` has them.

    Most sets only share a passage with the others of a group: sketches tell, before any shingle
    moves. Where pairs are counted, a set's groups are a few dozen, and it only moves to those in
    which it first meets a set that it may be linked with. Shingles move twice: from their texts
    to their set, and from there to its groups.
    """
    gids = F.array_sort(F.collect_list("gid")) if counted else F.array().cast("array<bigint>")
    every = scratch.save(groups.groupBy("sid").agg(gids.alias("gids")))
    dealt = _by_group(groups.join(_sketches_of(every, nodes).join(every, "sid"), "sid"))
    near = scratch.save(dealt.mapInArrow(tidy(_screen(screen_for(threshold))), "gid bigint, sid bigint, root bigint").distinct())
    met = scratch.save(near.join(nodes.select("sid", "sa", "sb", "th", "copies"), "sid").join(every, "sid"))
    out = scratch.save(_by_group(_whole(met, texts)).mapInArrow(tidy(_compare(threshold)), "a bigint, b bigint, links bigint"))
    scratch.drop(every, near, met)
    return out


def _open(large: DataFrame, nodes: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """``gid, sid, root, whole``: groups in which all sets of different classes meet that share a large bucket.

    A bucket of one class needs none. Where at most FEW sets lie outside the largest class, they
    meet each of its blocks: at most about twice the bucket's rows. Other buckets are split along
    further tokens while that leaves fewer pairs. It does not where sets are much alike, each going
    to two children with most of the others: such a bucket, and what is large at the deepest
    level, is a whole group, a row a set, for ``_across``.
    """
    rows = large.select("path", "sid").join(roots, "sid").join(_sketches_of(large, nodes), "sid")
    out, whole, spent = [], [], []
    for depth in range(DEPTH, DEEPEST + 1):
        rows = scratch.save(rows)
        by_class = rows.groupBy("path", "root").agg(F.count("*").alias("n"))
        sizes = by_class.groupBy("path").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top"))
        sizes = sizes.where(F.col("top.n") < F.col("size")).select("path", "size", F.col("top.n").alias("most"), F.col("top.root").alias("top"))
        here = scratch.save(rows.join(sizes, "path"))
        spent += [rows, here]
        few = (F.col("size") <= BLOCK) | (F.col("size") - F.col("most") <= FEW)
        blocks = F.when(F.col("size") <= BLOCK, 1).otherwise(F.ceil(F.col("most") / (BLOCK - FEW))).cast("int")
        own = F.array(F.pmod(F.xxhash64(F.lit(5), "path", "sid"), blocks).cast("int"))
        places = F.when(F.col("root") == F.col("top"), own).otherwise(F.sequence(F.lit(0), blocks - 1))
        met = here.where(few).select("path", "sid", "root", F.explode(places).alias("k"))
        out.append(met.select(F.xxhash64("path", "k").alias("gid"), "sid", "root", F.lit(False).alias("whole")))
        many = here.where(~few)
        if many.isEmpty():
            break
        if depth == DEEPEST:
            whole.append(many.select("path", "sid", "root"))
            break
        split = scratch.save(_children(many.select(F.col("path").alias("up"), "path", "size", "sid", "root", "mh"), 1.0))
        spent.append(split)
        pairs = split.groupBy("up", "size", "path").agg(F.count("*").alias("n")).groupBy("up", "size").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        less = scratch.save(pairs.where(F.col("pairs") < F.col("size") * F.col("size")).select("up"))
        spent.append(less)
        whole.append(many.join(less.select(F.col("up").alias("path")), "path", "left_anti").select("path", "sid", "root"))
        rows = split.join(less, "up", "left_semi").select("path", "sid", "root", "mh")
        if less.isEmpty():
            break
    if whole:
        buckets = whole[0]
        for x in whole[1:]:
            buckets = buckets.unionByName(x)
        out.append(_merged(buckets, scratch).withColumn("whole", F.lit(True)))
    groups = out[0]
    for x in out[1:]:
        groups = groups.unionByName(x)
    groups = scratch.save(groups)
    scratch.drop(*spent)
    return groups


def _merged(buckets: DataFrame, scratch: Scratch) -> DataFrame:
    """``gid, sid, root``: buckets ``path, sid, root``; those that are joined by sets in common are
    one group where it has no more pairs than they have in all, as runs find the same sets again."""
    buckets = scratch.save(buckets)
    least = buckets.groupBy("sid").agg(F.min("path").alias("a"))
    shared = buckets.join(least, "sid").select("a", F.col("path").alias("b"))
    tops = components(buckets.select(F.col("path").alias("sid")).distinct(), shared, scratch)
    rows = scratch.save(buckets.join(tops.select(F.col("sid").alias("path"), F.col("root").alias("gid")), "path"))
    square = F.col("n") * F.col("n")
    apart = rows.groupBy("gid", "path").agg(F.count("*").alias("n")).groupBy("gid").agg(F.sum(square).alias("apart"))
    sets = rows.select("gid", "sid").distinct().groupBy("gid").agg(F.count("*").alias("n"))
    one = sets.join(apart, "gid").select("gid", (square <= F.col("apart")).alias("one"))
    return rows.join(one, "gid").select(F.when(F.col("one"), F.col("gid")).otherwise(F.col("path")).alias("gid"), "sid", "root").distinct()


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``sid, root``: the least sid of each connected component.

    Each turn every set points to its least neighbour, pointers are followed to their ends, and
    the edges are drawn between these ends: what one turn has joined is one set in the next.
    """
    edges = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("to")), F.struct(F.col("b").alias("sid"), F.col("a").alias("to"))))).select("col.*")
        ends = scratch.save(ends.groupBy("sid").agg(F.min("to").alias("to")).select("sid", F.least("sid", "to").alias("root")))
        while True:
            up = ends.select(F.col("sid").alias("root"), F.col("root").alias("up"))
            new = scratch.save(ends.join(up, "root").select("sid", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
            scratch.drop(ends)
            ends = new
            if ends.where("moved").isEmpty():
                break
        left = edges
        for end in ("a", "b"):
            left = left.withColumnRenamed(end, "sid").join(ends.select("sid", F.col("root").alias(end)), "sid").drop("sid")
        left = scratch.save(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        scratch.drop(edges)
        edges, roots = left, ends.select("sid", "root") if roots is None else _moved(roots, ends)
    if roots is None:
        return nodes.select("sid", F.col("sid").alias("root"))
    return nodes.select("sid").join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))


def _moved(roots: DataFrame, ends: DataFrame) -> DataFrame:
    """``sid, root`` where roots have roots of their own, if ends ``sid, root`` has them."""
    up = ends.select(F.col("sid").alias("root"), F.col("root").alias("up"))
    return roots.join(up, "root", "left").select("sid", F.coalesce("up", "root").alias("root"))


def _medoid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``root, sid``: of each group the set whose sketch is most like the others'."""
    for group in _groups(batches, ("root", "sid", "mh")):
        best = _alike([g[2] for g in group]).sum(axis=1, dtype=np.int64).argmax()
        yield pa.RecordBatch.from_arrays([pa.array([group[0][0]], pa.int64()), pa.array([group[best][1]], pa.int64())], ["root", "sid"])


def _differences(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set as its difference from the pivot, which leads its rows: ``root, sid, class, copies, n, lost, pivot, core, diff``.

        ``lost`` is the number of the pivot's shingles that the set lacks. Two core sets lack so
        few that they are linked whatever else they hold.
        """
        names = ("root", "lead", "sid", "class", "copies", "shingles")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        share, p = threshold / (1 + threshold), np.empty(0, np.uint64)
        for b in batches:
            for at in range(0, len(b), 256):
                out = []
                for root, lead, sid, of, copies, packed in zip(*[b.column(c).slice(at, 256).to_pylist() for c in names], strict=True):
                    x = np.frombuffer(packed, np.uint64)
                    if lead:
                        p = x
                        continue
                    diff = np.setxor1d(p, x, assume_unique=True)
                    both = (len(p) + len(x) - len(diff)) // 2
                    out.append((root, sid, of, copies, len(x), len(p) - both, len(p), both - len(p) / 2 >= share * len(x), diff.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["root", "sid", "class", "copies", "n", "lost", "pivot", "core", "diff"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: ``root, core, k, pivot``, its sets' numbers and their differences, each in one binary."""
    for group in _groups(batches, ("gid", "root", "core", "k", "pivot", "sid", "class", "copies", "n", "lost", "diff")):
        diffs = [g[10] for g in group]
        facts = np.array([(*g[5:10], len(d) // 8) for g, d in zip(group, diffs, strict=True)], np.int64)
        row = (*group[0][1:5], facts.tobytes(), b"".join(diffs))
        types = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["root", "core", "k", "pivot", "facts", "diffs"])


def _block_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """The facts ``sid, class, copies, n, lost, size`` of two blocks, which of their sets are linked, and whether they are one block."""
    for group in _groups(batches, ("gid", "pivot", "facts", "diffs", "itself")):
        if len(group) == 1 and not group[0][4]:  # the other block has got no sets
            continue
        facts = [np.frombuffer(g[2], np.int64).reshape(-1, 6) for g in group]
        sets = [x for f, g in zip(facts, group, strict=True) for x in np.split(np.frombuffer(g[3], np.uint64), np.cumsum(f[:, 5])[:-1])]
        one, two = facts[0], facts[-1]
        # A shingle that both have or both lack besides the pivot's is one more that they share.
        both = overlaps(sets, len(one))[:, -len(two) :] + (group[0][1] - one[:, 4:5] - two[:, 4]).astype(np.float64)
        hit = both >= threshold * (one[:, 3:4] + two[:, 3] - both) - 1e-9
        if len(group) == 1:
            np.fill_diagonal(hit, False)
        yield one, two, hit, len(group) == 1


def _counted_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``sid, links``: the documents that a block's sets are linked with in the other block of a pair, or in the block itself."""
        for one, two, hit, itself in _block_pairs(batches, threshold):
            counts = [(one, hit @ two[:, 2])] + ([] if itself else [(two, hit.T @ one[:, 2])])
            for f, c in counts:
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(c.astype(np.int64))], ["sid", "links"])

    return run


def _linked_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``a, b``: links that connect the classes that are linked in a pair of blocks, or in a block."""
        for one, two, hit, itself in _block_pairs(batches, threshold):
            open_ = hit & (one[:, 1:2] != two[:, 1])
            if not open_.any():
                continue
            facts, linked = one, open_
            if not itself:
                facts = np.concatenate([one, two])
                linked = np.zeros((len(facts), len(facts)), bool)
                linked[: len(one), len(one) :] = open_
                linked |= linked.T
            edges = np.array(forest(linked, facts[:, 1:2] == facts[:, 1]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(facts[edges[:, 0], 0]), pa.array(facts[edges[:, 1], 0])], ["a", "b"])

    return run


def _in_blocks(members: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of groups ``root, sid, class``: a saved table of their sets, the sets dealt to blocks, and pairs of blocks.

    A group's sets become differences from one of them, the pivot, so that near copies are small.
    Core sets are all linked with each other and need no comparison; blocks of the others, a row
    each, meet all blocks.
    """
    members = scratch.save(members)
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    facts = nodes.select("sid", "copies", "sa", "sb", "th")
    dealt = scratch.save(members.join(sizes, "root").join(facts, "sid").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "sid"), F.col("parts")).cast("int")))
    least = dealt.groupBy("root").agg(F.min("part").alias("part"))
    first = dealt.join(least, ["root", "part"]).select("root", "sid")
    first = first.join(_sketches_of(first, nodes), "sid")
    pivots = scratch.save(first.repartition("root").sortWithinPartitions("root").mapInArrow(tidy(_medoid), "root bigint, sid bigint"))
    sets = scratch.save(_whole(dealt.select("sid", "sa", "sb", "th").distinct(), texts))
    leads = pivots.join(sizes, "root").select("root", "sid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    none = F.lit(0).cast("bigint")
    leads = leads.select("root", "part", F.lit(True).alias("lead"), "sid", none.alias("class"), none.alias("copies"))
    rows = leads.unionByName(dealt.select("root", "part", F.lit(False).alias("lead"), "sid", "class", "copies")).join(sets, "sid")
    rows = rows.repartition("root", "part").sortWithinPartitions("root", "part", F.col("lead").desc())
    diffs = scratch.save(rows.mapInArrow(tidy(_differences(threshold)), "root bigint, sid bigint, class bigint, copies bigint, n bigint, lost bigint, pivot bigint, core boolean, diff binary"))
    scratch.drop(members, dealt, pivots, sets)

    blocks = F.greatest(F.ceil(F.count("*") / (2 * BLOCK)), F.ceil(F.sum(F.length("diff")) / BLOCK_BYTES)).cast("int")
    kinds = diffs.groupBy("root", "core").agg(blocks.alias("blocks"), F.sum("copies").alias("all_copies"))
    numbers = kinds.groupBy("root").agg(*[F.sum(F.when(F.col("core") == core, F.col("blocks")).otherwise(0)).cast("int").alias(name) for core, name in ((False, "open"), (True, "closed"))])
    sets = diffs.join(kinds, ["root", "core"]).withColumn("k", F.pmod(F.xxhash64(F.lit(6), "sid"), F.col("blocks")).cast("int"))

    # Rim blocks come first; a pair has one of them at least.
    placed = sets.join(numbers.where("open > 0"), "root").withColumn("gid", F.xxhash64("root", "core", "k"))
    packed = placed.select("gid", "root", "core", "k", "pivot", "sid", "class", "copies", "n", "lost", "diff").repartition("gid").sortWithinPartitions("gid")
    packed = packed.mapInArrow(tidy(_pack), "root bigint, core boolean, k int, pivot bigint, facts binary, diffs binary").join(numbers, "root")
    at = F.when(F.col("core"), F.col("open") + F.col("k")).otherwise(F.col("k"))
    others = F.sequence(F.lit(0), F.col("open") - 1 + F.when(F.col("core"), 0).otherwise(F.col("closed")))
    pairs = packed.select("root", at.alias("at"), "pivot", "facts", "diffs", F.explode(others).alias("to"))
    pairs = pairs.select(F.xxhash64("root", F.least("at", "to"), F.greatest("at", "to")).alias("gid"), "pivot", "facts", "diffs", (F.col("at") == F.col("to")).alias("itself"))
    return diffs, sets, pairs.repartition("gid").sortWithinPartitions("gid")


def _across(groups: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``a, b``: links that connect all classes with linked sets in a group ``gid, sid, root``, by all its pairs, exactly."""
    diffs, sets, pairs = _in_blocks(groups.select(F.col("gid").alias("root"), "sid", F.col("root").alias("class")), nodes, texts, scratch, threshold)
    core = sets.where("core").select("root", "sid", "class")
    hubs = core.groupBy("root").agg(F.min(F.struct("sid", "class")).alias("hub"))
    sure = core.join(hubs, "root").where(F.col("class") != F.col("hub.class")).select(F.col("hub.sid").alias("a"), F.col("sid").alias("b"))
    out = scratch.save(sure.unionByName(pairs.mapInArrow(tidy(_linked_pairs(threshold)), "a bigint, b bigint")))
    scratch.drop(diffs)
    return out


def _all_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``sid, links``: how many documents of other sets each set is linked with, by all pairs of its class, exactly."""
    diffs, sets, pairs = _in_blocks(members.select("root", "sid", F.col("root").alias("class")), nodes, texts, scratch, threshold)
    sure = sets.select("sid", F.when(F.col("core"), F.col("all_copies") - F.col("copies")).otherwise(0).cast("bigint").alias("links"))
    found = pairs.mapInArrow(tidy(_counted_pairs(threshold)), "sid bigint, links bigint")
    out = scratch.save(sure.unionByName(found).groupBy("sid").agg(F.sum("links").alias("links")))
    scratch.drop(diffs)
    return out


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _joined(df: DataFrame, doc_id: str, text: str, threshold: float, recall: float, counted: bool = True) -> tuple[DataFrame, DataFrame, Scratch]:
    """The marked rows ``id, th, sa, sb, n, mh`` and the classes of sets: ``sa, sb, root, links, set_size, set_copies, least_id``; links are whole if counted."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), _text_hash(text).alias("th"))
    texts = rows.select("text", "th")
    marked = scratch.save(rows.mapInArrow(tidy(_sketches), f"id {dict(rows.dtypes)['id']}, th bigint, sa bigint, sb bigint, n int, mh binary"))
    grouped = marked.where("n > 0").groupBy("sa", "sb").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.any_value("n").alias("n"), F.any_value("mh").alias("mh"), F.any_value("th").alias("th"))
    nodes = scratch.save(grouped.withColumn("sid", F.monotonically_increasing_id()))
    leaves = _leaves(nodes, scratch, runs_for(recall, threshold))

    block = F.pmod(F.xxhash64(F.lit(5), "path", "sid"), F.ceil(F.col("size") / BLOCK))
    gid = F.when(F.col("size") <= BLOCK, F.col("path")).otherwise(F.xxhash64("path", block))
    found = _found(leaves.select(gid.alias("gid"), "sid", F.col("sid").alias("root")), nodes, texts, scratch, threshold, True)
    roots = scratch.save(components(nodes, found.where("b is not null"), scratch))
    counts = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    large = leaves.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        groups = _open(large, nodes, roots, scratch)
        between = _found(groups.where("not whole").drop("whole"), nodes, texts, scratch, threshold, False).where("b is not null").select("a", "b")
        whole = groups.where("whole")
        if not whole.isEmpty():
            between = between.unionByName(_across(whole, nodes, texts, scratch, threshold))
        for end in ("a", "b"):  # links between sets become links between their classes
            between = between.withColumnRenamed(end, "sid").join(roots.select("sid", F.col("root").alias(end)), "sid").drop("sid")
        between = scratch.save(between.distinct())
        if not between.isEmpty():
            roots = scratch.save(_moved(roots, components(roots.select(F.col("root").alias("sid")).distinct(), between, scratch)))
        if counted:  # in a large bucket most pairs have not met: its classes are counted as a whole
            again = large.select("sid").distinct().join(roots, "sid").select("root").distinct()
            every = _all_links(roots.join(again, "root"), nodes, texts, scratch, threshold)
            counts = counts.join(every, "sid", "left_anti").unionByName(every)
    node = nodes.join(roots, "sid").join(counts, "sid", "left")
    node = node.select("sa", "sb", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("n").alias("set_size"), F.col("copies").alias("set_copies"), "least_id")
    return marked, scratch.save(node), scratch


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``doc_id, class_id, links, set_size, set_copies``.

    Two documents are linked if their shingle sets' Jaccard similarity is at least the threshold;
    a class is a connected component of links and its id, which stands for the class, is the
    least doc_id in it. ``links`` counts all other documents that this one is linked with: those
    with an equal set, and those of the sets that share a bucket with its own; classes with sets
    in buckets beyond BLOCK are counted by all their pairs.

    Texts without a word have no shingles and no links: each is its own class (a null id then
    gives a null class). Null text counts as empty; very long texts are whole sets; repeated rows
    count as documents of their own; rows with a null id take part and rank last. Other columns
    than the two are not read. An empty table gives no rows.
    """
    marked, node, _ = _joined(df, doc_id, text, threshold, recall)
    least = node.groupBy("root").agg(F.min("least_id").alias("class_id"))
    node = node.join(least, "root").select("sa", "sb", "class_id", "links", "set_copies")
    out = marked.select("id", "sa", "sb", "n").join(node, ["sa", "sb"], "left")
    return out.select(
        F.col("id").alias(doc_id),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).cast("bigint").alias("links"),
        F.col("n").alias("set_size"),
        F.when(F.col("n") > 0, F.col("set_copies")).otherwise(F.lit(1)).cast("bigint").alias("set_copies"),
    )


def keep_one_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each class: that of the least id (null last), then of the least hash of
    its text, then of all its columns. Texts without a word are all kept.

    Rows are told apart by id and text, so ids may be null or repeat. Columns may have any names.
    """
    marked, node, scratch = _joined(df, doc_id, text, THRESHOLD, RECALL, counted=False)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    keys = marked.where("n > 0").groupBy("id", "th", "sa", "sb").agg(F.count("*").alias("rows"))
    keys = scratch.save(keys.join(node.select("sa", "sb", "root"), ["sa", "sb"]).select("id", "th", "root", "rows"))
    best = keys.groupBy("root").agg(F.min(rank).alias("best"))
    judged = keys.join(best, "root").select("id", "th", "rows", (F.col("best") == rank).alias("stays"))
    odd = scratch.save(judged.where("not stays or rows > 1").select("id", "th", "stays"))  # all that does not just stay
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), _text_hash(f"`{text}`").alias("th"), row.alias("row"))

    def same(other: DataFrame) -> Column:
        return rows["id"].eqNullSafe(other["id"]) & (rows["th"] == other["th"])

    kept = rows.join(odd, same(odd), "left_anti").select("row")
    repeated = odd.where("stays")
    if not repeated.isEmpty():
        one = rows.join(repeated, same(repeated), "left_semi").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
