"""Freely typed institution names mapped to a reference list.

The reference list becomes a trie of whole entries: each entry's leading (brand) part, from whose end the alias paths of its
kind of institution go on (written out, shortened by rule, or as initials); entries of one kind share these paths. A name is
read against the trie by a Levenshtein automaton (one row of edit distances per trie node, adjacent transpositions counted as
one edit), with a limit that grows with the length. An alias path is met exactly where it can be, as one letter apart can mean
another kind; only a name that meets none exactly may have typing errors there. Names that begin with the kind take the same
paths the other way round. Names in Devanagari, romanised in many ways, are read against a trie of the brands' consonants in
the same manner. ``candidates`` returns all entries within the limit, ``map_names`` the one that is meant.

Distinct names are searched once each, and joined back to their rows.

Defined results: null and blank names give no rows; a name without an entry within the limits, or equally near to
several, gives ``bank_id`` -1. Several catalogue rows with one name give the smallest id. An empty catalogue makes every
name unmatched. The catalogue is held by each worker, so its size is checked against ``max_entries`` first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

#: What each kind of institution is called, and how its words are shortened besides by leaving out vowels.
CALLED = {
    "small": ("small finance bank", "small finance", "laghu vitta bank"), "payments": ("payments bank", "payment bank"), "coop": ("cooperative bank", "sahakari bank", "cooperative", "sahakari"),
    "gramin": ("gramin bank", "grameen bank", "gramin", "grameen"), "of": ("bank of",), "plain": ("bank",),
}
SHORT = {"bank": ("bk",), "finance": ("fin",), "cooperative": ("coop",)}


def _paths(called: tuple[str, ...]) -> tuple[str, ...]:
    """The alias paths of a kind, run together: each word in full, shortened, or without its vowels; or the initials."""
    forms = lambda w: (w, *SHORT.get(w, ()), w[0] + re.sub("[aeiou]", "", w[1:]))
    out = ["".join(p) for name in called for p in product(*[forms(w) for w in name.split()])]
    return tuple(dict.fromkeys([*out, "".join(w[0] for w in called[0].split())] if " " in called[0] else out))


KINDS: dict[str, tuple[str, ...]] = {k: _paths(v) for k, v in CALLED.items()}
#: Initials of each kind, as they follow the first letter of the brand.
INITIALS = {"small": ("sfb",), "payments": ("pb",), "coop": ("cob", "cb"), "gramin": ("gb",), "plain": ("b",)}
LEGAL = ("limited", "ltd")
#: Words before a name that aren't part of it.
_LEAD = re.compile(r"^(?:m\s*/\s*s\.?|a\s*/\s*c\s+with|bank\s*:|name\s*:|from|to|the|with)\s+|^(?:bank|name)\s*:", re.I)

_VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", ("a", "a", "i", "i", "u", "u", "ri", "e", "ai", "o", "au", "o", "e")))
_SIGNS = dict(zip("ािीुूृेैोौॉॅ", ("a", "i", "i", "u", "u", "ri", "e", "ai", "o", "au", "o", "e")))
_CONSONANTS = dict(
    zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split())
)
#: Words of kinds and legal forms as they are written in Devanagari.
_DEVANAGARI_WORDS = {
    "स्मॉल": "small", "फाइनेंस": "finance", "पेमेंट्स": "payments", "पेमेंट": "payment", "बैंक": "bank", "बँक": "bank",
    "सहकारी": "sahakari", "को-ऑपरेटिव": "cooperative", "ग्रामीण": "gramin", "लिमिटेड": "limited", "लि": "ltd", "ऑफ": "of",
}


def romanise(word: str) -> str:
    """A Devanagari word in Latin letters, with the inherent vowel dropped at its end."""
    if word in _DEVANAGARI_WORDS:
        return _DEVANAGARI_WORDS[word]
    out: list[str] = []
    bare = False  # whether the last consonant still waits for its vowel
    for ch in unicodedata.normalize("NFD", word).replace("़", ""):
        if ch in _CONSONANTS:
            out.append("a" * bare + _CONSONANTS[ch])
            bare = True
        elif ch in _SIGNS:
            out.append(_SIGNS[ch])
            bare = False
        elif ch == "्":
            bare = False
        else:
            out.append("a" * bare + _VOWELS.get(ch, "n" if ch in "ंँ" else "" if unicodedata.category(ch)[0] == "M" else ch))
            bare = False
    return "".join(out)


def words(name: str) -> list[str]:
    """Lower-case words of ``name``, romanised, without leading phrases and punctuation."""
    x = unicodedata.normalize("NFKC", name).strip().casefold()
    while (m := _LEAD.match(x)) and m.end() < len(x):
        x = x[m.end() :].strip()
    x = x.replace("&", " and ")
    x = re.sub(r"\b((?:\w\.\s?){2,})", lambda m: m[1].replace(".", "").replace(" ", "") + " ", x)
    out = []
    for w in re.findall(r"[a-z0-9]+|(?:[ऀ-ॿ]|-(?=[ऀ-ॿ]))+", x):
        out.append(romanise(w) if w[0] > "ࣿ" else w)
    return out


def insert(trie: dict, word: str, payload: object) -> None:
    for ch in word:
        trie = trie.setdefault(ch, {})
    trie.setdefault("", []).append(payload)


#: More edits than any limit.
FAR = 99


def walk(trie: dict, text: str, start: list[int], widest: int) -> Iterator[tuple[object, list[int]]]:
    """(payload, row) of every word of ``trie`` that can be within ``widest`` edits: row[i] is the number of edits by which the
    word, after what ``start`` stands for, becomes the first i letters of ``text``."""

    # only what is within ``widest`` counts, and that lies in a narrow band of each row
    n = len(text)

    def down(node: dict, ch: str, above: list[int], before: list[int] | None, last: str, low: int, high: int) -> Iterator[tuple[object, list[int]]]:
        row = [FAR] * (n + 1)
        first, end, i = -1, -1, low
        while i <= n and (i <= high + 1 or row[i - 1] < widest):
            cost = above[i] + 1
            if i:
                c = text[i - 1]
                cost = min(cost, row[i - 1] + 1, above[i - 1] + (c != ch))
                if before is not None and i > 1 and c == last and text[i - 2] == ch:
                    cost = min(cost, before[i - 2] + 1)
            if cost <= widest:
                row[i], end = cost, i
                if first < 0:
                    first = i
            i += 1
        if first < 0:
            return
        for payload in node.get("", ()):
            yield payload, row
        for c, child in node.items():
            if c:
                yield from down(child, c, row, above, ch, first, end)

    near = [i for i, d in enumerate(start) if d <= widest]
    if near:
        for c, child in trie.items():
            if c:
                yield from down(child, c, start, None, "", near[0], near[-1])


class Catalogue:
    """The trie and its alias paths."""

    #: The shared part of the trie: alias paths of all kinds.
    aliases: dict = {}
    for _kind_name, _all in KINDS.items():
        for _path in _all:
            insert(aliases, _path, (_kind_name, len(_path)))

    def __init__(self, entries: list[tuple[int, str]]) -> None:
        self.trie: dict = {}
        self.skeletons: dict = {}
        self.kinds: dict[str, dict[str, int]] = {}
        self.initials: dict[str, set[tuple[str, int]]] = {}
        for bank_id, name in sorted(entries):
            brand, kind = self._split(words(name))
            if not brand or bank_id is None:
                continue
            if brand not in self.kinds:
                insert(self.trie, brand, brand)
                insert(self.skeletons, consonants(brand), brand)
            by = self.kinds.setdefault(brand, {})
            if kind in by:
                continue
            by[kind] = bank_id
            for short in INITIALS.get(kind, ()):
                for legal in ("", "l"):
                    self.initials.setdefault(brand[0] + short + legal, set()).add((brand, bank_id))

    @staticmethod
    def _split(parts: list[str]) -> tuple[str, str]:
        """Brand and kind of a clean catalogue name."""
        if parts[:1] == ["the"]:
            parts = parts[1:]
        while parts and parts[-1] in LEGAL:
            parts = parts[:-1]
        whole = "".join(parts)
        if parts[:2] == ["bank", "of"]:
            return whole[6:], "of"
        ends = [(len(a), k, a) for k, aliases in KINDS.items() if k != "of" for a in aliases if whole.endswith(a) and len(whole) > len(a)]
        if not ends:
            return whole, ""
        size, kind, _ = max(ends)
        return whole[:-size], kind

    @staticmethod
    def limit(size: int) -> int:
        """Edits allowed for a brand of ``size`` letters."""
        return 0 if size < 4 else 1 if size < 6 else 2

    def brands(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(brand, letters of ``text`` used, edits) for every brand within its limit of a prefix of ``text``."""
        for brand, row in walk(self.trie, text, list(range(len(text) + 1)), 2):
            for i, d in enumerate(row):
                if d <= self.limit(len(brand)):
                    yield brand, i, d

    def whole(self, text: str, bounds: set[int]) -> Iterator[tuple[str, str, int]]:
        """(brand, kind, edits) of every entry whose brand and alias path together, either way round, are within the limit of a
        beginning of ``text`` that ends between words."""
        size = len(text) + 1

        def within(row: list[int], most: int) -> list[int]:
            return [d if d <= most else FAR for d in row]

        for brand, row in walk(self.trie, text, list(range(size)), 2):
            for (kind, length), end in walk(self.aliases, text, within(row, self.limit(len(brand))), 2):
                d = min((end[i] for i in bounds), default=FAR)
                if kind != "of" and length > 2 and d <= self.limit(len(brand) + length):
                    yield brand, kind, d
        for (kind, length), row in walk(self.aliases, text, list(range(size)), 1):
            if length < 4:
                continue
            start = [d if i in bounds and d <= self.limit(length) else FAR for i, d in enumerate(row)]
            if min(start) > 1:
                continue
            for brand, end in walk(self.trie, text, start, 2):
                d = min((end[i] for i in bounds), default=FAR)
                if d <= self.limit(len(brand) + length):
                    yield brand, kind, d

    @staticmethod
    def _kind(rest: str, bounds: set[int]) -> set[tuple[str, int]]:
        """(kind, letters used) where ``rest`` begins with an alias path that ends between words."""
        return {(k, len(a)) for k, aliases in KINDS.items() for a in aliases if rest.startswith(a) and len(a) in bounds}

    def search(self, name: str) -> list[tuple[int, int]]:
        """(edits, bank_id) of all entries within the limits, nearest first; id -1 for a known brand without such a kind."""
        parts = words(name)
        if not parts:
            return []
        text = "".join(parts)
        ends = set()
        at = 0
        for w in parts:
            at += len(w)
            ends.add(at)
        found: dict[int, int] = {}

        def offer(brand: str, kind: str, edits: int) -> None:
            bank = self.kinds[brand].get(kind, -1)
            if bank not in found or edits < found[bank]:
                found[bank] = edits

        variants = {text, text.translate(str.maketrans("015", "ols")), text.replace("rn", "m").translate(str.maketrans("015", "ols"))}
        for v in variants:
            shift = len(text) - len(v)
            bounds = {e - shift for e in ends} if shift else ends
            # brand first; the rest must begin with the path of a kind
            for brand, used, edits in self.brands(v):
                rest = v[used:]
                ks = self._kind(rest, {e - used for e in bounds})
                ks = {(k, n) for k, n in ks if k != "of" or "of" in self.kinds[brand]}
                if ks:
                    longest = max(n for _, n in ks)
                    for k, n in ks:
                        if n == longest:
                            offer(brand, k, edits)
            # kind first
            lead = self._kind(v, bounds)
            if lead:
                longest = max(n for _, n in lead)
                for k, n in lead:
                    if n != longest:
                        continue
                    rest = v[n:]
                    for legal in (*LEGAL, "br"):
                        if rest.startswith(legal) and n + len(legal) in bounds:
                            rest = rest[len(legal) :]
                            break
                    used_up = len(v) - len(rest)
                    for brand, used, edits in self.brands(rest):
                        if used_up + used in bounds:
                            offer(brand, k, edits)
                            if k == "plain" and "of" in self.kinds[brand]:
                                offer(brand, "of", edits)
        if not found:
            # no alias path is met exactly: typing errors there as well
            for v in sorted(variants):
                shift = len(text) - len(v)
                for brand, kind, edits in self.whole(v, {e - shift for e in ends}):
                    if kind in self.kinds[brand]:
                        offer(brand, kind, edits)
        return sorted((d, b) for b, d in found.items())

    def match(self, name: str, hint: str | None = None, near: list[tuple[int, int]] | None = None) -> int:
        """The entry that is meant, or -1. ``near``: what ``nearest`` gives, if it is known. ``hint``: a code that begins with the brand's first letters."""
        lead = (hint or "")[:4].casefold()
        parts = words(name)
        if len(parts) == 1 and parts[0] in self.initials:
            near = {b for brand, b in self.initials[parts[0]] if not lead or brand.startswith(lead)} or {b for _, b in self.initials[parts[0]]}
            return min(near) if len(near) == 1 else -1
        near = self.nearest(name) if near is None else near
        if not near:
            return -1
        best = [b for d, b in near if d == near[0][0]]
        best = [b for b in best if b >= 0] or best
        return best[0] if len(best) == 1 else -1

    def nearest(self, name: str) -> list[tuple[int, int]]:
        """What ``search`` finds, or, for names in Devanagari, the search by consonants."""
        got = self.search(name)
        return got if got or not any(ord(c) > 0x8FF for c in name) else self.search_devanagari(name)

    def search_devanagari(self, name: str) -> list[tuple[int, int]]:
        """Romanised names are spelled in many ways: brands are compared by their consonants."""
        parts = words(name)
        out: dict[int, int] = {}
        for cut in range(1, len(parts) + 1):
            rest = "".join(parts[cut:])
            ks = self._kind(rest, {len("".join(parts[cut:j])) for j in range(cut + 1, len(parts) + 1)})
            if not ks:
                continue
            kind = max(ks, key=lambda x: x[1])[0]
            heads = consonants("".join(parts[:cut]))
            scored = sorted((row[-1], brand) for brand, row in walk(self.skeletons, heads, list(range(len(heads) + 1)), 2))
            if scored and scored[0][0] <= 1 and (len(scored) < 2 or scored[1][0] > scored[0][0]):
                out[self.kinds[scored[0][1]].get(kind, -1)] = scored[0][0]
            break
        return sorted((d, b) for b, d in out.items())


def consonants(latin: str) -> str:
    x = latin.replace("ksh", "x").replace("ks", "x").replace("w", "v").replace("ph", "f").replace("sh", "s").replace("z", "j")
    x = x.replace("m", "n").replace("y", "i").replace("c", "k").replace("kh", "k").replace("q", "k")
    return re.sub(r"(.)\1+", r"\1", re.sub("[aeiouh]", "", x))


def load(catalogue: DataFrame, id: str = "bank_id", name: str = "bank_name", max_entries: int = 200_000) -> list[tuple[int, str]]:
    """The reference list; more than ``max_entries`` rows are refused, since each worker holds it."""
    rows = catalogue.select(F.col(id).cast("long").alias("i"), F.col(name).alias("n")).where("i is not null and n is not null").limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"the reference list has more than {max_entries} entries")
    return [(r.i, r.n) for r in rows]


def _searched(df: DataFrame, catalogue: DataFrame, id: str, name: str, hint: str | None, max_entries: int) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the rows with a name, and each distinct name with the entry that is meant and all within the limit."""
    entries = load(catalogue, max_entries=max_entries)
    rows = df.select(
        F.col(id).cast("long").alias("id"), F.col(name).cast("string").alias("name_"), F.coalesce((F.col(hint) if hint else F.lit(None)).cast("string"), F.lit("")).alias("hint")
    ).where(F.trim(F.regexp_replace("name_", r"[\s\x{00A0}]+", " ")) != "")
    # searching is work of milliseconds a name, so that few names are spread over all cores too
    names = rows.select("name_", "hint").distinct().repartition(3 * df.sparkSession.sparkContext.defaultParallelism, "name_", "hint")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Catalogue(entries)
        for f in frames:
            found = [known.nearest(n) for n in f.name_]
            meant = [known.match(n, h, x) for n, h, x in zip(f.name_, f.hint, found)]
            near = [[{"bank_id": b, "edits": d} for d, b in x if b >= 0] for x in found]
            yield pd.DataFrame({"name_": f.name_, "hint": f.hint, "bank_id": pd.Series(meant, dtype="int64", index=f.index), "near": near})

    return rows, written(names.mapInPandas(work, "name_ string, hint string, bank_id long, near array<struct<bank_id:long,edits:int>>"))


def map_names(df: DataFrame, catalogue: DataFrame, id: str = "detection_id", name: str = "bank_name", hint: str | None = "ifsc", max_entries: int = 200_000) -> DataFrame:
    """(id, bank_id): the entry of ``catalogue`` that each name means, -1 where it has none."""
    rows, names = _searched(df, catalogue, id, name, hint, max_entries)
    return rows.join(names, ["name_", "hint"]).select(F.col("id").alias(id), "bank_id")


def candidates(df: DataFrame, catalogue: DataFrame, id: str = "detection_id", name: str = "bank_name", max_entries: int = 200_000) -> DataFrame:
    """(id, bank_id, edits): all entries of ``catalogue`` within the length-dependent limit of each name."""
    rows, names = _searched(df, catalogue, id, name, None, max_entries)
    return rows.join(names, ["name_", "hint"]).select(F.col("id").alias(id), F.explode("near").alias("x")).select(id, "x.bank_id", "x.edits")
