"""Surrogates for personal data: keyed, type-consistent replacements.

Detected entities (e-mail, IP address, card, phone, account number, secret, titled name) are
replaced by keyed permutations of their own format. With a keyed bijection E on the strings of
a format, an entity x becomes ``E^-1(E(x) + c)`` for a keyed c that is not 0: a bijection again,
so distinct entities keep distinct surrogates, and without fixed points. The same entity has the
same surrogate everywhere (coreference). First names are dealt within pools by gender and
script, other names letter by letter and never into a pool. What collides all the same is found
by a count over all distinct entities and dealt anew.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, documents, without

#: Attempts that keep an entity's format; later ones draw longer words, which end every collision.
ATTEMPTS = 3
#: Entities that need another attempt than the first and are broadcast; more of them are an error.
MOST_EXCEPTIONS = 1_000_000
#: The key of the registered query, whose tables are made. Callers of ``replaced`` give their own, in secret.
QUERY_KEY = b"key of the query on made tables"

#: Titles that announce a name, with the name's gender; and first names by gender and script (fixed values).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Госпожа": "f",
}
FIRST_NAMES = {
    ("m", "latin"): ["James", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Hans", "Karl", "Pierre", "Jean", "Louis", "Carlos", "Miguel", "Antonio", "George"],
    ("f", "latin"): ["Mary", "Linda", "Susan", "Anna", "Laura", "Emma", "Julia", "Marie", "Claire", "Sophie", "Carmen", "Lucia", "Elena", "Greta", "Heidi", "Alice"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Алексей", "Сергей", "Николай", "Михаил", "Андрей", "Дмитрий"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}

def _letters(category: str) -> str:
    """Latin, Greek and Cyrillic letters beyond ASCII."""
    return "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530)]) if unicodedata.category(c) == category)


_UP, _LOW = "A-Z" + _letters("Lu"), "a-z" + _letters("Ll")
_NAME = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
#: What stands left of an @, and right of it.
_LOCAL = re.compile(r"[\w.+-]*\w\Z")
_DOMAIN = re.compile(r"[^\W_](?:(?:[^\W_]|-)*[^\W_])?(?:\.[^\W_](?:(?:[^\W_]|-)*[^\W_])?)*?\.[^\W\d_]{2,}(?![^\W_]|-|\.[^\W_])")
_SECRET = re.compile(r"(?:token|secret|api_key|password|key)[\"']?[ \t]*[=:][ \t]*([\"'])([A-Za-z0-9_+/=-]{16,})\1", re.IGNORECASE)
#: What each secret holds; a search for it is fast.
_QUOTED = re.compile(r"[=:][ \t]*[\"'][A-Za-z0-9_+/=-]{16}")
#: A run of digits and their separators; the number patterns are tried inside such runs only.
_RUN = re.compile(r"[0-9][0-9 ().-]{5,}")
_NUMBER = re.compile(
    r"(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?!\w)|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
)
#: Titles are written as above or all in capitals (in small letters some are everyday words), and so are names.
_GENDERS = TITLES | {t.upper(): g for t, g in TITLES.items()}
_SHOUTED = rf"[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})?(?![{_LOW}])"
_TITLED = re.compile(rf"\b({'|'.join(_GENDERS)})\.? ({_NAME}(?: {_NAME})?|{_SHOUTED}(?: {_SHOUTED})?)")
#: The titles again, by their first letters: a search for one of a few letters is fast.
_CUE = re.compile("[" + "".join(sorted({t[0] for t in _GENDERS})) + "](?:" + "|".join(sorted({t[1:] for t in _GENDERS}, key=len, reverse=True)) + r")\b")


def luhn_digit(digits: str) -> str:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and canonical form of each entity, from left to right, none overlapping.

    Literal cues (an @, a quote, a digit, a title) lead to the few places where patterns run.
    """
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = at, _DOMAIN.match(text, at + 1)
        while right and left and (text[left - 1].isalnum() or text[left - 1] in "_.+-"):
            left -= 1
        if right and left < at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            found.append((left, right.end(), "email", text[left : right.end()].lower()))
        at = text.find("@", at + 1)
    if _QUOTED.search(text):
        found += [(*m.span(2), "secret", m[2]) for m in _SECRET.finditer(text)]
    for run in _RUN.finditer(text):
        start = run.start()
        while start and text[start - 1] in "+(":
            start -= 1
        for m in _NUMBER.finditer(text, start, min(len(text), run.end() + 2)):
            kind, x = m.lastgroup, m[0]
            digits = re.sub(r"[^0-9]", "", x)
            if kind == "card":
                found.append((*m.span(), "card" if luhn_digit(digits[:-1]) == digits[-1] else "account", digits))
            else:
                found.append((*m.span(), kind, x if kind == "ip" else ("+" if x[0] == "+" else "") + digits))
    if _CUE.search(text):
        names = [(*m.span(2), "name_" + _GENDERS[m[1]], m[2].title() if m[2].isupper() else m[2]) for m in _TITLED.finditer(text)]
        found += names
        # The same person without a title: the whole name again, as it was written.
        for written, kind, canonical in sorted({(text[a:b], k, c) for a, b, k, c in names if " " in c}):
            again = [m.span() for m in re.finditer(rf"\b{re.escape(written)}(?!\w)", text)]
            taken = {(a, b) for a, b, _, _ in names}
            found += [(a, b, kind, canonical) for a, b in again if (a, b) not in taken]
    found.sort()
    out: list[tuple[int, int, str, str]] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


class Keyed:
    """Permutations under one key. ``attempt`` re-deals an entity that collided."""

    def __init__(self, key: bytes):
        self.key = key

    def number(self, *what: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest()[:16], "big")

    def shifted(self, x: int, size: int, tweak: str) -> int:
        """E^-1(E(x) + c) mod size for a keyed c other than 0: a bijection without fixed points."""
        if size < 2:
            return x
        c = 1 + self.number(tweak, size, "c") % (size - 1)
        return self._walk((self._walk(x, size, tweak, 1) + c) % size, size, tweak, -1)

    def _walk(self, x: int, size: int, tweak: str, way: int) -> int:
        a = max(2, int(size**0.5) + 1)
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for r in range(4) if way > 0 else reversed(range(4)):
                if r % 2 == 0:
                    left = (left + way * self.number(tweak, r, right)) % a
                else:
                    right = (right + way * self.number(tweak, r, left)) % b
            x = left * b + right
            if x < size:  # cycle walking
                return x

    def digits(self, s: str, tweak: str) -> str:
        return str(self.shifted(int(s), 10 ** len(s), f"{tweak}{len(s)}")).zfill(len(s)) if s else s

    def word(self, s: str, tweak: str) -> str:
        """Letters become letters of the same script, case and kind, digits digits; signs stay."""
        x, size, places = 0, 1, []
        for c in s:
            letters = alphabet(c)
            if len(letters) > 1:
                x, size = x * len(letters) + letters.index(c), size * len(letters)
            places.append(letters)
        y = self.shifted(x, size, f"{tweak}{''.join(p if len(p) == 1 else p[0] for p in places)}")
        out = []
        for p in reversed(places):
            if len(p) == 1:
                out.append(p)
            else:
                y, k = divmod(y, len(p))
                out.append(p[k])
        return "".join(reversed(out))

    def name(self, canonical: str, tweak: str) -> str:
        """Name by name: a first name within its pool, others by their letters, a first one never into a pool.

        Each is a bijection, so that whole names are dealt by one too, whatever their titles.
        """
        names = canonical.split(" ")
        out = []
        for k, n in enumerate(names):
            first = k == 0 and len(names) > 1
            pool = next((p for p in FIRST_NAMES.values() if n in p), None) if first else None
            if pool:
                out.append(pool[self.shifted(pool.index(n), len(pool), tweak + "first")])
                continue
            new = self.word(n, tweak)
            while first and new in _POOLED:  # cycle walking
                new = self.word(new, tweak)
            out.append(new)
        return " ".join(out)

    def surrogate(self, kind: str, canonical: str, attempt: int = 0) -> str:
        t = f"{'name' if kind.startswith('name') else kind}/{attempt}/"
        if attempt > ATTEMPTS:
            return canonical + "".join(alphabet(c)[self.number(t, canonical, k) % len(alphabet(c))] for k, c in enumerate("Xx" + "x" * attempt))
        if kind == "email":
            local, _, domain = canonical.partition("@")
            name, dot, top = domain.rpartition(".")
            host, _, rest = name.partition(".")
            # The organisation's own label changes as one word; example domains stay in their reserved zone.
            base = f"{host and self.word(host, 'domain')}.{rest}" if rest else self.word(name, "domain")
            return f"{self.word(local, t)}@{base}{dot}{top}"
        if kind == "ip":
            x = int.from_bytes(bytes(map(int, canonical.split("."))), "big")
            return ".".join(map(str, self.shifted(x, 1 << 32, t).to_bytes(4, "big")))
        if kind == "card":
            head, body = canonical[:1], canonical[1:-1]
            body = self.digits(body, t + head)
            return head + body + luhn_digit(head + body)
        if kind == "account":
            while True:  # stays without a valid check digit: walk on
                canonical = self.digits(canonical, t)
                if luhn_digit(canonical[:-1]) != canonical[-1]:
                    return canonical
        if kind == "phone":
            plus, rest = ("+", canonical[1:]) if canonical[0] == "+" else ("", canonical)
            keep = len(rest) - 10 if len(rest) > 10 else min(2, len(rest) - 1) if plus else 0
            return plus + rest[:keep] + self.digits(rest[keep:], t + plus + rest[:keep])
        if kind == "ssn":
            return self.digits(canonical, t)
        return self.name(canonical, t) if kind.startswith("name") else self.word(canonical, t)

    def as_written(self, written: str, kind: str, surrogate: str) -> str:
        """The surrogate in the entity's own format: separators and case as they were."""
        if kind in ("phone", "ssn", "card", "account"):
            digits = iter(re.sub(r"\D", "", surrogate))
            return "".join(next(digits) if c.isdigit() else c for c in written)
        if kind == "email" and len(surrogate) == len(written):
            return "".join(s.upper() if w.isupper() else s for w, s in zip(written, surrogate, strict=True))
        if kind.startswith("name") and written.isupper():
            return surrogate.upper()
        return surrogate


#: Vowels and consonants of each script and case change among themselves (fixed values).
_ALPHABETS = (
    ("digits", "0123456789"),
    ("vowels", "aeiou"), ("consonants", "bcdfghjklmnpqrstvwxyz"),
    ("capital vowels", "AEIOU"), ("capital consonants", "BCDFGHJKLMNPQRSTVWXYZ"),
    ("accented", "àáâäåèéêëìíîïòóôöùúûü"), ("capital accented", "ÀÁÂÄÅÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ"), ("other", "çñß"), ("capital other", "ÇÑ"),
    ("cyrillic vowels", "аеёиоуыэюя"), ("cyrillic consonants", "бвгджзйклмнпрстфхцчшщ"),
    ("capital cyrillic vowels", "АЕЁИОУЫЭЮЯ"), ("capital cyrillic consonants", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ"),
)


_LISTED = frozenset("".join(letters for _, letters in _ALPHABETS))
_POOLED = frozenset(n for p in FIRST_NAMES.values() for n in p)


@lru_cache(1 << 16)
def alphabet(c: str) -> str:
    """The characters that one changes among: its list above, or for other letters and digits those
    of the same general category on the same 256 code points; a sign stands alone."""
    for _, letters in _ALPHABETS:
        if c in letters:
            return letters
    category = unicodedata.category(c)
    if category[0] != "L" and category != "Nd":
        return c
    page = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(page, page + 256)) if x not in _LISTED and unicodedata.category(x) == category)


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``kind, canonical`` of all texts, names of either gender as ``name``; entities repeat within a batch only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({(k.partition("_")[0], c) for t in b.column(0) if t.is_valid for _, _, k, c in find(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.string()) for j in (0, 1)], ["kind", "canonical"])

    return df.select(text).mapInArrow(run, "kind string, canonical string").distinct()


def exceptions(df: DataFrame, key: bytes, text: str = "text") -> dict[tuple[str, str], int]:
    """Entities whose first surrogate collides, with the attempt that does not.

    The check covers all distinct entities: surrogates are counted, and all but the least entity
    of each surrogate, and entities that are their own, go to the next attempt, until every
    surrogate is single and new. By construction next to none do, but for entities without a
    letter or digit that could change. The loop ends: late attempts draw from ever longer words.
    """
    scratch = Scratch(df.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for b in batches:
            out = [keyed.surrogate(k, c, a) for k, c, a in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], ["kind", "canonical", "attempt", "surrogate"])

    schema = "kind string, canonical string, attempt int, surrogate string"
    dealt = scratch.save(entities(df, text).withColumn("attempt", F.lit(0)).mapInArrow(deal, schema))
    same = F.col("surrogate") == F.col("canonical")
    while True:
        clash = dealt.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canonical")).alias("first")).where("n > 1")
        clash = scratch.save(clash)
        if clash.isEmpty() and dealt.where(same).isEmpty():
            break
        joined = dealt.join(clash, ["kind", "surrogate"], "left")
        again = F.coalesce((F.col("n").isNotNull() & (F.struct("attempt", "canonical") != F.col("first"))) | same, F.lit(False))
        dealt = scratch.save(joined.select("kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt")).mapInArrow(deal, schema))
    odd = dealt.where("attempt > 0")
    if odd.count() > MOST_EXCEPTIONS:
        raise ValueError("more exceptions than may be broadcast; use another key")
    return {(r.kind, r.canonical): r.attempt for r in odd.select("kind", "canonical", "attempt").collect()}


def replaced(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """df with its text rewritten, and ``entities`` (a list of kind, start, end in the old text).

    Who knows the key can undo the surrogates, so there is no default. Whole texts, also very long
    ones; null stays null, and a text without entities stays as it is. Repeated rows get equal
    results, and an empty table gives no rows. Start and end are code points. A column of df named
    ``entities`` gives way to the result. What isn't found is left: names without a title that
    no titled mention spells out, national phone and account formats beside those above, streets.
    """
    df = without(df, "entities")
    odd = df.sparkSession.sparkContext.broadcast(exceptions(df, key, text))
    at, names = df.columns.index(text), [*df.columns, "entities"]
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key)
        for b in batches:
            texts, found = [], []
            for t in b.column(at):
                x = t.as_py()
                out, last, spots = [], 0, []
                for start, end, kind, canonical in find(x) if x else ():
                    new = keyed.surrogate(kind, canonical, odd.value.get((kind.partition("_")[0], canonical), 0))
                    out += [x[last:start], keyed.as_written(x[start:end], kind, new)]
                    spots.append({"kind": kind, "start": start, "end": end})
                    last = end
                texts.append(x if not out else "".join([*out, x[last:]]))
                found.append(spots)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, spans)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, entities array<struct<kind:string,start:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)
