"""SentencePiece encoding and decoding with n-best segmentation.

The piece lattice of a text has a node between any two characters and an edge for each piece.
Forward Viterbi gives the best score from the start to each node; A-star then searches backward
from the end with these scores as exact heuristic, so hypotheses leave the agenda in order of
their whole score. Where no piece contains two neighbouring characters the node between them is
on every path: the search runs between such nodes, once a distinct stretch, and the n-best lists
of stretches merge into the text's, which is exact. Scores are whole micronats, so sums agree in
any order and ties break by piece ids.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, tidy, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
SPACE = "\u2581"
#: A byte piece costs so many micronats more than the rarest piece.
BYTE_COST = 10_000_000
#: Words, and an eighth as many n-best lists, that are kept at most; then they are worked out anew.
CACHE = 1 << 17
#: Words that go through a lattice at once, and rows and bytes of text that are segmented at once.
TOGETHER, ROWS, BYTES = 1024, 512, 1 << 20

Path = tuple[int, tuple[int, ...]]


class Pieces:
    """A model's pieces and scores, and the segmenter.

    Unigram models are used with their log-probabilities. BPE models hold merge ranks instead:
    ranks become log-probabilities by Zipf's law, ``-log(rank + 2) - log(sum of all)``.
    """

    def __init__(self, model: bytes, nbest: int = NBEST):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.nbest, self.ids, self.byte_ids, self.bytes = nbest, {}, {}, []
        scores = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes.append(b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else piece.replace(SPACE, " ").encode())
            if self.bytes[-1]:
                self.ids[piece], scores[piece] = i, sp.get_score(i)
        if len(self.byte_ids) != 256:
            raise ValueError("the model needs byte pieces, else texts can't be restored")
        ranked = all(s == int(s) for s in scores.values())
        total = math.log(sum(1 / (2 - s) for s in scores.values())) if ranked else 0
        self.scores = {p: round(1e6 * (-math.log(2 - s) - total if ranked else s)) for p, s in scores.items()}
        low = min(self.scores.values()) - BYTE_COST
        self.byte_score = low
        self.starts = {p[:k] for p in self.scores for k in range(1, len(p) + 1)}
        self.inside = {a + b for p in self.scores for a, b in zip(p, p[1:], strict=False)}
        #: Whether a run of spaces always begins a new stretch.
        self.spaces_begin = not any(x[0] != SPACE and x[1] == SPACE for x in self.inside)
        self.stretches, self.lists = {}, {}
        self._tables()
        self._forget()

    def _tables(self) -> None:
        """Direct tables by a hash of the piece; each piece lies in one of them."""
        self.char_ids = np.zeros(0x110000, np.uint64)
        for i, c in enumerate(sorted({c for p in self.scores for c in p}), 1):
            self.char_ids[ord(c)] = i
        self.longest = max(map(len, self.scores))
        hashes = {p: int(self._hash(np.array([[ord(c)] for c in p], np.uint32), len(p))[-1][0, 0]) for p in self.scores}
        if len(set(hashes.values())) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.slots, rest = [], hashes
        for m in MULTIPLIERS:  # few pieces are left for each further table, so it is small
            bits = (32 * len(rest)).bit_length()
            keys, ids, left = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}
            for p, h in rest.items():
                at = h * m % (1 << 64) >> 64 - bits
                if ids[at] < 0:
                    keys[at], ids[at] = h, self.ids[p]
                else:
                    left[p] = h
            self.slots.append((m, bits, keys, ids))
            if not (rest := left):
                break
        else:
            raise ValueError("a piece found no slot")
        self.id_scores = np.zeros(len(self.bytes), np.int64)
        for p, x in self.scores.items():
            self.id_scores[self.ids[p]] = x
        self.spelling = pa.array(self.bytes, pa.binary())

    def _hash(self, chars: np.ndarray, longest: int) -> list[np.ndarray]:
        """Hashes of all substrings of the columns: for each length an array (start, column)."""
        c = self.char_ids[chars] + np.uint64(1)
        out = [c * np.uint64(MULTIPLIERS[0])]
        for k in range(2, longest + 1):
            out.append((out[-1][:-1] ^ (out[-1][:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c[k - 1 :])
        return out

    def _piece_ids(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for m, bits, keys, ids in self.slots:  # an empty place has no piece, which is what out holds already
            at = h * np.uint64(m) >> np.uint64(64 - bits)
            hit = keys[at] == h
            out[hit] = np.maximum(out[hit], ids[at[hit]])
        return out

    def learn(self, words: list[str]) -> None:
        """Forward Viterbi over the lattices of new words, all words of one length at once.

        Keeps the two best scores of each node, so a word's entry has its best ids, their score
        and what its second path loses. Long and odd words go through the search.
        """
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > LONGEST_WORD or SPACE in w or not self.spaces_begin:
                self._enter(w, self.paths(w))
            else:
                by_length.setdefault(len(w) + 1, []).append(w)
        for n, every in by_length.items():
            for at in range(0, len(every), TOGETHER):
                self._learn_alike(n, every[at : at + TOGETHER])

    def _learn_alike(self, n: int, group: list[str]) -> None:
        """Enters words of n characters, the space mark among them."""
        text = "".join([SPACE + w for w in group]).replace(" ", SPACE)
        chars = np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).T)
        top = min(n, self.longest)
        ids = [self._piece_ids(h) for h in self._hash(chars, top)]
        scores = [np.where(i >= 0, self.id_scores[i], NO_EDGE) for i in ids]
        size = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        scores[0] = np.where(ids[0] >= 0, scores[0], self.byte_score * size)
        best, second = np.zeros((n + 1, len(group)), np.int64), np.full((n + 1, len(group)), NO_EDGE)
        taken = np.zeros((n + 1, len(group)), np.int8)
        for j in range(1, n + 1):
            a, b, t = best[j - 1] + scores[0][j - 1], second[j - 1] + scores[0][j - 1], np.ones(len(group), np.int8)
            for k in range(2, min(j, top) + 1):
                w = scores[k - 1][j - k]
                x = best[j - k] + w
                t[x > a] = k
                b = np.maximum(np.maximum(b, second[j - k] + w), np.minimum(a, x))
                a = np.maximum(a, x)
            best[j], second[j], taken[j] = a, b, t
        gap = np.where(second[n] > NO_EDGE // 2, best[n] - second[n], NEVER)
        flat, ends = self._read_back(chars, ids, taken, n)
        raw, at = flat.tobytes(), [0, *(4 * ends).tolist()]
        self._entered(group, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], best[n], gap)

    def _read_back(self, chars, ids, taken, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best paths' ids, row after row, and where each row ends."""
        rows = np.arange(chars.shape[1])
        node = np.full(len(rows), n)
        who, where, what = [], [], []
        while (live := node > 0).any():
            r, j = rows[live], node[live]
            k = taken[j, r].astype(np.int64)
            got = np.zeros(len(r), np.int32)
            for size in np.unique(k):
                m = k == size
                got[m] = ids[size - 1][j[m] - size, r[m]]
            plain = got >= 0
            who.append(r[plain])
            where.append((j - k)[plain] * 4)
            what.append(got[plain])
            for row, at in zip(r[~plain].tolist(), (j - k)[~plain].tolist(), strict=True):
                raw = chr(chars[at, row]).encode("utf-8", "surrogatepass")
                who.append(np.full(len(raw), row))
                where.append(at * 4 + np.arange(len(raw)))
                what.append(np.array([self.byte_ids[b] for b in raw], np.int32))
            node[live] = j - k
        who, where, what = np.concatenate(who), np.concatenate(where), np.concatenate(what)
        order = np.lexsort((where, who))
        return what[order].astype(np.int32), np.cumsum(np.bincount(who, minlength=len(rows)))

    def _enter(self, word: str, paths: list[Path]) -> None:
        gap = paths[0][0] - paths[1][0] if len(paths) > 1 else NEVER
        self._entered([word], [np.array(paths[0][1], np.int32).tobytes()], [paths[0][0]], [gap])

    def _forget(self) -> None:
        """No words are known: their numbers, best ids, and by number scores, gaps and how many ids."""
        self.known, self.raws, self.facts = {}, [], np.empty((3, 0), np.int64)
        self.fresh: list[np.ndarray] = []

    def _entered(self, words: list[str], raws: list[bytes], scores, gaps) -> None:
        self.known.update(zip(words, range(len(self.raws), len(self.raws) + len(words)), strict=True))
        self.raws += raws
        self.fresh.append(np.array([scores, gaps, [len(x) // 4 for x in raws]], np.int64))

    def paths(self, word: str) -> list[Path]:
        """The n best paths of one word, by the search."""
        if (found := self.lists.get(word)) is None:
            if len(self.lists) >= CACHE // 8:
                self.lists.clear()
            if SPACE in word:
                found = self._spelled(word)
            else:
                found = self.stretch(SPACE + word.replace(" ", SPACE))
            if (k := self.known.get(word)) is not None:  # of equal paths the entry's own comes first
                own = tuple(np.frombuffer(self.raws[k], np.int32).tolist())
                found = [(found[0][0], own), *[p for p in found if p[1] != own]][: max(1, len(found))]
            self.lists[word] = found
        return found

    def _spelled(self, word: str) -> list[Path]:
        """A word that holds the space mark itself: its marks are bytes, so it parts there."""
        parts = word.split(SPACE)
        raw = SPACE.encode()
        mark = (self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw))
        lists = [self.stretch(SPACE + parts[0].replace(" ", SPACE))]
        for rest in parts[1:]:
            lists.append([mark])
            if rest:
                lists.append(self.stretch(rest.replace(" ", SPACE)))
        return self.merged(lists)

    def edges(self, s: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each node the edges that end there: start, score, ids."""
        out: list[list] = [[] for _ in range(len(s) + 1)]
        for i in range(len(s)):
            known = False
            j = i + 1
            while j <= len(s) and s[i:j] in self.starts:
                p = s[i:j]
                if p in self.scores:
                    out[j].append((i, self.scores[p], (self.ids[p],)))
                    known |= j == i + 1
                j += 1
            if not known:
                raw = s[i].encode("utf-8", "surrogatepass")
                out[i + 1].append((i, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
        return out

    def search(self, s: str) -> list[Path]:
        """The n best paths of one lattice: score and ids, best first."""
        ends = self.edges(s)
        best = [0] + [0] * len(s)
        for j in range(1, len(s) + 1):  # forward Viterbi
            best[j] = max(best[i] + w for i, w, _ in ends[j])
        # Backward A-star: an entry is (-whole score, ids read backward, node, score behind it, tail).
        agenda = [(-best[len(s)], (), len(s), 0, None)]
        found: list[Path] = []
        while agenda and len(found) < self.nbest:
            _, _, node, behind, tail = heapq.heappop(agenda)
            if node == 0:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                found.append((behind, tuple(ids)))
                continue
            for i, w, ids in ends[node]:
                g = behind + w
                heapq.heappush(agenda, (-(g + best[i]), ids, i, g, (ids, tail)))
            if len(agenda) > 64 * self.nbest + 4096:  # only the n best entries of a node can be among the n best paths
                agenda = self._pruned(agenda)
        return found

    def _pruned(self, agenda: list) -> list:
        seen: dict[int, int] = {}
        kept = []
        for x in sorted(agenda, key=itemgetter(0, 1, 2, 3)):
            seen[x[2]] = seen.get(x[2], 0) + 1
            if seen[x[2]] <= self.nbest:
                kept.append(x)
        return kept

    def merged(self, parts: list[list[Path]]) -> list[Path]:
        """The n best of all sums of one path a part."""
        picks = self.picks([p[0][0] - p[1][0] if len(p) > 1 else None for p in parts], parts)
        score = sum(p[0][0] for p in parts)
        out = []
        for loss, changed in picks:
            ids = chain.from_iterable(p[changed.get(k, 0)][1] for k, p in enumerate(parts))
            out.append((score - loss, tuple(ids)))
        return out

    def picks(self, gaps: list[int | None], parts: list[list[Path]]) -> list[tuple[int, dict[int, int]]]:
        """Losses and changed parts of the n best sums.

        A sum among the n best changes only parts whose first gap is among the n - 1 smallest:
        any other has n sums that lose no more than it does.
        """
        least = heapq.nsmallest(self.nbest - 1, ((g, k) for k, g in enumerate(gaps) if g is not None))
        out: list[tuple[int, tuple]] = [(0, ())]
        for _, k in least:
            p = parts[k]
            out = heapq.nsmallest(self.nbest, ((a + p[0][0] - p[r][0], (*c, (k, r)) if r else c) for a, c in out for r in range(len(p))))
        return [(a, dict(c)) for a, c in out]

    def stretch(self, s: str) -> list[Path]:
        """A string that begins with its space marks, cut where no piece crosses."""
        cuts = [0, *[i for i in range(1, len(s)) if s[i - 1 : i + 1] not in self.inside], len(s)]
        parts = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = s[a:b]
            if (p := self.stretches.get(x)) is None:
                if len(self.stretches) >= CACHE // 8:
                    self.stretches.clear()
                p = self.search(x)
                if len(x) <= 64:
                    self.stretches[x] = p
            parts.append(p)
        return parts[0] if len(parts) == 1 else self.merged(parts)

    def split(self, text: str) -> list[str]:
        """Words without their first space; a run of spaces stays before its word."""
        if not self.spaces_begin:
            return [text]
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        return [x[1:] for x in _RUNS.findall(" " + text)]

    def prepare(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Texts as words, the words' numbers, and where each text's begin; all words are known until the next call."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self._forget()
        new = set().union(*split) - self.known.keys()
        self.learn(sorted(new))
        if self.fresh:
            self.facts, self.fresh = np.concatenate([self.facts, *self.fresh], axis=1), []
        starts = np.cumsum([0, *map(len, split)])
        return split, np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(starts[-1])), starts

    def best(self, numbers: np.ndarray) -> np.ndarray:
        """The best ids of words, one word after the other."""
        return np.frombuffer(b"".join(map(self.raws.__getitem__, numbers.tolist())), np.int32)

    def ranked(self, words: list[str], gaps: np.ndarray) -> tuple[list[int], list[dict[int, int]]]:
        """What each of the n best loses in micronats, and the words that it changes.

        A sum among the n best changes only words whose gap is among the n - 1 smallest: any
        other has n sums that lose no more than it does.
        """
        few = min(self.nbest - 1, len(gaps))
        least = np.flatnonzero(gaps <= np.partition(gaps, few - 1)[few - 1]) if few else []
        least = sorted((int(gaps[k]), int(k)) for k in least)[:few]
        out: list[tuple[int, tuple]] = [(0, ())]
        for g, k in least:
            if g < NEVER:
                p = self.paths(words[k])
                out = sorted([(a + p[0][0] - p[r][0], (*c, (k, r)) if r else c) for a, c in out for r in range(len(p))])[: self.nbest]
        return [a for a, _ in out], [dict(c) for _, c in out]

    def overlays(self, words: list[str], ends: np.ndarray, sizes: np.ndarray, changed: list[dict[int, int]]) -> list[list[dict]]:
        """For each of the n best what it has in place of the best ids: from ``at`` on ``cut`` ids become ``ids``."""
        return [[{"at": int(ends[k] - sizes[k]), "cut": int(sizes[k]), "ids": list(self.paths(words[k])[r][1])} for k, r in sorted(c.items())] for c in changed]

    def segmented(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[list[int], list[dict[int, int]], list[list[dict]]]]]:
        """All best ids, where each text's begin, and for each text the n best: scores, changed words, overlays."""
        split, numbers, starts = self.prepare(texts)
        score, gap, size = self.facts[:, numbers]
        total = np.r_[0, np.cumsum(size)]
        sums = np.r_[0, np.cumsum(score)]
        out = []
        for words, a, b in zip(split, starts.tolist(), starts[1:].tolist(), strict=False):
            losses, changed = self.ranked(words, gap[a:b])
            best = int(sums[b] - sums[a])
            out.append(([best - x for x in losses], changed, self.overlays(words, total[a + 1 : b + 1] - total[a], size[a:b], changed)))
        return self.best(numbers), total[starts], out

    def nbest_ids(self, text: str | None) -> list[tuple[int, list[int]]]:
        """The n best segmentations in full: score in micronats and ids."""
        words = self.prepare([text or ""])[0][0]
        _, _, ((scores, changed, _),) = self.segmented([text or ""])
        return [(s, [i for k, w in enumerate(words) for i in self.paths(w)[c.get(k, 0)][1]]) for s, c in zip(scores, changed, strict=True)]

    def spelled(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Decodes many lists of ids that lie one after the other."""
        whole = self.spelling.take(pa.array(flat))
        raw = whole.buffers()[2].to_pybytes() if len(flat) else b""
        at = np.frombuffer(whole.buffers()[1], np.int32, len(flat) + 1)[ends] if len(flat) else np.zeros(len(ends), int)
        return [raw[a:b].decode("utf-8", "surrogatepass")[1:] for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of any of its segmentations, exactly."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of at most ROWS rows and, unless a text alone has more, BYTES bytes."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and (i - at >= ROWS or size + n > BYTES):
            yield at, i - at
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts) - at


NEVER = 1 << 60
#: Less than any path's score, and so little that a word's sum of them fits.
NO_EDGE = -(1 << 50)
LONGEST_WORD = 48
#: Odd 64-bit multipliers of the tables.
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_RUNS = re.compile(" +[^ ]*")


#: The n best as overlays of the best ids, in Arrow.
_OVERLAYS = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("cut", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def overlaid(ids: list[int], changes: list) -> list[int]:
    """The ids of one of the n best: the best ids with its changes, which are in order."""
    out, last = [], 0
    for c in changes:
        out += [*ids[last : c["at"]], *c["ids"]]
        last = c["at"] + c["cut"]
    return [*out, *ids[last:]]


def encoded(df: DataFrame, model: str = MODEL, nbest: int = NBEST, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, *keep, ids, n_pieces, score, nbest_scores, nbest_changes, round_trip``.

    The best ids come from forward Viterbi; the other segmentations of a word, and all of words
    that are long or odd, from the backward A-star search; lists of words merge into the text's.
    For a BPE model the scores are those of a unigram reading of its ranks (see ``Pieces``), so
    ids may differ from those that the model's own merges give.

    ``nbest_changes`` has for each of the n best what it changes in ``ids`` (nothing for the
    best itself): ``overlaid`` and ``decoded(rank=...)`` give it in full. ``score`` and ``nbest_scores`` are log-probabilities; fewer than nbest if a text has fewer
    segmentations. ``round_trip``: every one of the n best decodes to the text. Null and empty
    texts have no pieces and one segmentation of score 0. Equal rows get equal results. Long texts
    are segmented whole, one beside a batch in memory. An empty table gives no rows. A column of
    keep that has the name of a result gives way to it.
    The model file is read by the driver and broadcast (half a MB).
    """
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def segment(pieces: Pieces, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() or "" for t in part.column("text")]
        flat, ends, done = pieces.segmented(texts)
        spelled = pieces.spelled(flat, ends)
        over = [d[2] for d in done]
        trips = []
        for t, s, o, a in zip(texts, spelled, over, ends.tolist(), strict=False):
            # Texts are their ids' bytes one after the other, so it is enough to decode what changes.
            trips.append(s == t and all(_spell(pieces, x["ids"]) == _spell(pieces, flat[a + x["at"] : a + x["at"] + x["cut"]].tolist()) for c in o for x in c))
        cols = [part.column(k) for k in range(len(names) - 6)]
        scores = [[x / 1e6 for x in d[0]] for d in done]
        cols += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(np.diff(ends), pa.int32()), pa.array([x[0] for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(over, _OVERLAYS), pa.array(trips, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value, nbest)
        for b in batches:
            for at, rows in slices(b.column("text")):
                yield segment(pieces, b.slice(at, rows))  # what one slice needs is free before the next

    results = ["ids", "n_pieces", "score", "nbest_scores", "nbest_changes", "round_trip"]
    keep = tuple(c for c in dict.fromkeys(keep) if c.lower() not in {doc_id.lower(), *results})
    rows = df.select(F.col(doc_id), *keep, F.col(text).alias("text")) if "text" not in keep else df.select(doc_id, *keep)
    kinds = dict(df.dtypes)
    names = [doc_id, *keep, *results]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (doc_id, *keep))
    return rows.mapInArrow(tidy(run), f"{schema}, ids array<int>, n_pieces int, score double, nbest_scores array<double>, nbest_changes array<array<struct<at:int,cut:int,ids:array<int>>>>, round_trip boolean")


def _spell(pieces: Pieces, ids: list[int]) -> bytes:
    return b"".join(map(pieces.bytes.__getitem__, ids))


def decoded(df: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "text", rank: int = 0, changes: str = "nbest_changes") -> DataFrame:
    """df with the text of its ids, or of the segmentation of another rank of the n best.

    Null ids give a null text, and so does a rank that a row doesn't have. A column of df that
    has the name of the result gives way to it. An empty table gives no rows.
    """
    df = without(df, to)
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    at, names = df.columns.index(ids), [*df.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value, 1)
        for b in batches:
            every = b.column(at).to_pylist()
            if rank:
                every = [None if x is None or c is None or rank >= len(c) else overlaid(x, c[rank]) for x, c in zip(every, b.column(names.index(changes)).to_pylist(), strict=True)]
            texts = [None if x is None else pieces.decode(x) for x in every]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(tidy(run), f"{kinds}, `{to}` string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
