"""Personal data in free text: found, and replaced by typed placeholders.

A skip-chain conditional random field labels the words of each document. Word shapes, affixes, neighbours and pattern
matches score each word, learned transitions link neighbours within a line, and skip edges link repeated or similar words
that may be names (equal but for case and punctuation, or alike in their first letters) across the document, however far
apart. Loopy message passing runs over all lines until no message moves any more. Chains, transitions and the potentials of
the skip edges are learned, the latter over whole made-up documents. Spans are then checked exactly: e-mail addresses, phone
and identity numbers must be well-formed, addresses and names are trimmed to their own words.

Edges join each word to its neighbours among its like, so that a word that occurs n times has n - 1 edges.

Defined results: null and empty texts hold nothing. Each distinct value of a type is reported once per document. Repeated
rows give repeated results. Lines of any length are labelled whole, in batches and blocks of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chains import marginals
from ledgerloom.llm.pii_seeds import OTHERS, PATTERNS, Maker
from ledgerloom.llm.seeds import SENTENCES
from ledgerloom.session import spread

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
DIMS = 1 << 18
_DIGITS = str.maketrans("०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯௦௧௨௩௪௫௬௭௮௯", "0123456789" * 3)

_NINES = str.maketrans("0123456789०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯௦௧௨௩௪௫௬௭௮௯", "9" * 40)

_USER = r"[A-Za-z0-9][A-Za-z0-9._%+-]*"
EMAIL = re.compile(
    rf"{_USER}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    rf"|{_USER}\s?[\[(](?:at|AT)[\])]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[(](?:dot|DOT)[\])]\s?)[A-Za-z0-9-]+)+"
    rf"|{_USER} AT [A-Za-z0-9-]+(?: DOT [A-Za-z0-9-]+)+"
)
#: Digits in groups, with an optional country code or area code in brackets. What may stand before is asked after the first
#: character, as a pattern that begins with a set of characters is found faster.
PHONE = re.compile(
    r"[+(\d](?<![\w/.,-].)(?:(?<=\+)\d{1,3}[ -]?(?:\(\d{2,5}\)[ -]?)?\d|(?<=\()\d{2,5}\)[ -]?\d|(?<=\d))[\d .-]{5,16}\d(?![\w/]|[.,-]\d)"
    r"|\d(?<![\w/.-].)\d{1,4}/\d{5,9}(?![\w/])"
)
IDENTITY = re.compile(
    r"(?<![\w/-])(?:[A-Za-z]{5} ?\d{4} ?[A-Za-z]|\d{4}([ -]?)\d{4}\1\d{4}|[A-Za-z]{3}\d{7}|[A-Za-z]{2}\d{2}[ -]?\d{11}|[A-Za-z]\d{7,8})(?![\w/-])"
)
_LABEL_WORDS = frozenset(
    "pan aadhaar aadhar uid voter card epic passport licence license dl identité ausweisnummer पैन आधार मतदाता पासपोर्ट permanent driving pièce पहचान".split()
)
_TOKEN, _NEWLINE = re.compile(r"\S+"), re.compile("\n")
_LEAD, _TRAIL = "<([{\"'“‘*•-–", ".,;:!?>)]}\"'”’।|"
#: Titles and roles that stand before a name and aren't part of it.
_TITLES = re.compile(r"^(?:(?:Shri|Smt|Mr|Mrs|Ms|Dr|Mme|Mlle|Herrn?|Frau|Kum|श्रीमती|श्री|Prof|holder|titulaire|nominee|deponent|खाताधारक)\.?:?\s+|c/o\s+|sd/-\s*)", re.I)


#: A small word before a name in capitals.
_SMALL = re.compile(r"^[a-zà-ÿ]{1,4}\s+(?=[A-ZÀ-Ý])")


@lru_cache(maxsize=100_000)
def _shape(w: str) -> str:
    """Kinds of letters, digits and signs; long runs shortened, words of an Indic script without their length."""
    x = re.sub(r"[\u0900-\u097f]+", "d", re.sub(r"[\u0980-\u0dff]+", "g", w.translate(_NINES)))
    x = re.sub(r"[a-zß-ÿ]", "a", re.sub(r"[A-ZÀ-Ý]", "A", x)) if x not in ("d", "g") else x
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", x)


#: Where the features of a word come from: itself, its neighbours, and the only word of the line before.
PLACES = (0, -1, 1, -2, 2, "above")
#: Kinds of skip edges: equal as written, equal but for case and punctuation, alike in their first letters.
EDGES = 3


def parts(raw: str) -> tuple[str, str, str]:
    """(punctuation before, word, punctuation after) of what stands between blanks."""
    a, b = 0, len(raw)
    while a < b and raw[a] in _LEAD:
        a += 1
    while b > a and raw[b - 1] in _TRAIL:
        b -= 1
    return raw[:a], raw[a:b], raw[b:]


def word_features(raw: str) -> dict:
    """Feature names of a word, by the place that they are seen from, in the order of PLACES. Digits count by their number only."""
    lead, core, trail = parts(raw)
    shape, low = _shape(core), core.lower()
    # numbers and the like are known by their shape
    name = f"w{low}" if not any(c.isdigit() for c in core) else f"s{shape}"
    own = [name, f"s{shape}", f"p{low[:3]}", f"p4{low[:4]}", f"e{low[-3:]}", f"e2{low[-2:]}", f"l{lead}", f"t{trail}", f"L{lead}|{shape[:2]}", f"T{trail}|{shape[:2]}", "bias"]
    near = [name, f"s{shape}", f"e{low[-3:]}"]
    return {
        0: own, -1: [f"-{x}" for x in near] + [f"-t{trail}", f"-r{name}|{trail}"], 1: [f"+{x}" for x in near] + [f"+l{lead}", f"+r{name}|{lead}"],
        -2: [f"--{name}", f"--{shape}|{trail}"], 2: [f"++{name}"], "above": [f"^{name}|{trail}"],
    }


def _ids(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) % DIMS for x in names]


class Words:
    """What is known of each word: numbers of its word, shape and keys, and its part of the scores seen from each place."""

    BOUNDS = ("\x02", "\x03")

    def __init__(self, weights: np.ndarray | None = None) -> None:
        #: None while weights are still learned: then only features are kept, and no scores.
        self.weights = weights
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.facts: list[tuple[int, ...]] = []
        self.tables: list[list[np.ndarray]] = [[] for _ in PLACES]
        self.ids: list[list[list[int]]] = []
        self.pairs: dict[tuple, np.ndarray] = {}
        self.pair_ids: dict[tuple, int] = {}
        for x in self.BOUNDS:
            self.add(x)

    def _named(self, x: str | None) -> int:
        return -1 if x is None else self.names.setdefault(x, len(self.names))

    def add(self, raw: str) -> int:
        """The number of a word; words that differ in digits only share it."""
        i = self.number.get(raw)
        if i is not None:
            return i
        plain = raw.translate(_NINES)
        i = self.number.get(plain)
        if i is None:
            i, raw_given, raw = len(self.facts), raw, plain
            self.number[raw] = self.number[raw_given] = i
            lead, core, trail = parts(raw)
            key = skip_key(core)
            stem = None if key is None or len(key) < 5 else "^" + (key[:5] if key[0] < "\u0900" else key[:4])
            self.facts.append(
                (len(lead), len(trail), self._named(_shape(core)), self._named("w" + core.lower()), self._named(key), self._named(stem), self._named("=" + core), int(core.lower().rstrip(".:") in _LABEL_WORDS), int(not core),
                 int("9" in raw), int("@" in raw or core == "AT" or re.search(r"[\[(](?:at|AT)[\])]", raw) is not None), int("9999" in raw))
            )
            feats = [_ids(v) for v in word_features(raw).values()]
            if self.weights is None:
                self.ids.append(feats)
            else:
                for table, f in zip(self.tables, feats):
                    table.append(self.weights[f].sum(axis=0))
        else:
            self.number[raw] = i
        return i


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, as many as its size says, one run after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Batch:
    """Documents as flat arrays of words: lines are chains, one after the other."""

    def __init__(self, words: Words, texts: list[str]) -> None:
        self.texts = texts
        ids: list[int] = []
        starts: list[int] = []
        sizes: list[int] = []
        docs, lines, lines_at = [], [], []
        get, begun = words.number.get, 0
        for d, text in enumerate(texts):
            found = list(_TOKEN.finditer(text))
            if not found:
                continue
            raws = [m.group() for m in found]
            got = [get(r) for r in raws]
            ids += [words.add(r) if i is None else i for i, r in zip(got, raws)] if None in got else got
            at = [m.start() for m in found]
            starts += at
            sizes += map(len, raws)
            ends = np.array([m.start() for m in _NEWLINE.finditer(text)], np.int64)
            line = np.searchsorted(ends, at)
            begin = np.concatenate(([0], ends + 1))
            used, first = np.unique(line, return_index=True)
            docs.append(np.full(len(raws), d))
            lines.append(first + begun)
            lines_at.append(begin[used])
            begun += len(raws)
        whole = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.ids, self.docs, self.first, self.line_at = np.array(ids, np.int64), whole(docs), whole(lines), whole(lines_at)
        self.lengths = np.diff(np.append(self.first, len(ids)))
        facts = np.array(words.facts, np.int64)[self.ids] if ids else np.zeros((0, len(words.facts[0])), np.int64)
        raw_starts = np.array(starts, np.int64)
        raw_ends = raw_starts + np.array(sizes, np.int64)
        self.starts, self.ends = raw_starts + facts[:, 0], raw_ends - facts[:, 1]
        self.line = np.repeat(np.arange(len(self.lengths)), self.lengths)
        # patterns are looked for in lines with a digit, or with a sign of an address
        marks: dict[int, tuple[str, int]] = {}
        for flag, patterns in ((9, (("P", PHONE),)), (11, (("I", IDENTITY),)), (10, (("E", EMAIL),))):
            for c in np.unique(self.line[facts[:, flag] == 1]).tolist():
                lo, hi, begin = int(self.first[c]), int(self.first[c] + self.lengths[c]), int(self.line_at[c])
                text = texts[self.docs[lo]][begin : int(raw_ends[hi - 1])]
                for tag, pattern in patterns:
                    for m in pattern.finditer(text):
                        a, b = m.span()
                        size = sum(x.isdigit() for x in m[0])
                        i = max(lo, lo + int(np.searchsorted(raw_starts[lo:hi], begin + a, "right")) - 1)
                        k = 0
                        while i < hi and raw_starts[i] < begin + b:
                            if raw_ends[i] > begin + a:
                                marks[i] = (marks[i][0] if i in marks else "") + f"{tag}{'B' if k == 0 else 'I'}{size}", 0
                                k += 1
                            i += 1
        self.shape, self.word, self.key, self.stem, self.form = facts[:, 2], facts[:, 3], facts[:, 4], facts[:, 5], facts[:, 6]
        n = len(ids)
        self.around = {0: self.ids}
        for k in (-1, 1, -2, 2):
            to = np.arange(n) + k
            ok = (to >= 0) & (to < n)
            ok[ok] = self.line[to[ok]] == self.line[ok]
            self.around[k] = np.where(ok, self.ids[np.clip(to, 0, max(n - 1, 0))] if n else 0, 0 if k < 0 else 1)
        # the line before, if it has one word only
        above = np.full(len(self.lengths), -1)
        if len(above) > 1:
            same = self.docs[self.first[1:]] == self.docs[self.first[:-1]]
            above[1:] = np.where(same & (self.lengths[:-1] == 1), self.ids[self.first[:-1]], -1)
        self.above = np.full(n, -1)
        self.above[self.first] = above
        label = np.where(facts[:, 7] == 1, np.arange(n), -100)
        last = np.concatenate(([-100], np.maximum.accumulate(label)[:-1])) if n else label
        self.labelled = (np.arange(n) - last <= 5) & (last >= self.first[self.line]) if n else np.zeros(0, bool)
        self.marks = marks
        self.pairs = self._pairs(words)

    def _pairs(self, words: Words) -> list[list[tuple]]:
        """Features of two facts together, as arrays of keys: shape with the word before, with the shapes at either side, and
        what patterns match with the label or the word before."""
        shapes = np.array([f[2] for f in words.facts])
        named = np.array([f[3] for f in words.facts])
        before, after = self.around[-1], self.around[1]
        size = np.minimum(self.lengths, 5)[self.line] * 2 + (np.arange(len(self.ids)) == self.first[self.line])
        joined = [("A", self.shape, named[before]), ("B", self.shape, shapes[after]), ("C", self.shape, shapes[before]), ("N", self.shape, size)]
        keyed = []
        for tag, x, y in joined:
            keyed.append((tag, (x << 32) + y))
        return keyed

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of all words for all labels."""
        tables = [np.array(t, np.float32) for t in words.tables]
        out = sum(tables[PLACES.index(k)][self.around[k]] for k in (0, -1, 1, -2, 2))
        has = self.above >= 0
        out[has] += tables[-1][self.above[has]]
        for tag, keys in self.pairs:
            unique, inverse = np.unique(keys, return_inverse=True)
            got = np.empty((len(unique), len(LABELS)), np.float32)
            for i, k in enumerate(unique.tolist()):
                found = words.pairs.get((tag, k))
                if found is None:
                    found = words.pairs[tag, k] = words.weights[self.pair_feature(words, tag, k)]
                got[i] = found
            out += got[inverse]
        for i, names in self.mark_features(words):
            out[i] += words.weights[_ids(names)].sum(axis=0)
        return out

    @staticmethod
    def pair_feature(words: Words, tag: str, k: int) -> int:
        got = words.pair_ids.get((tag, k))
        if got is None:
            if len(getattr(words, "spelled", ())) != len(words.names):
                words.spelled = list(words.names)
            x, y = words.spelled[k >> 32], k & 0xFFFFFFFF
            got = words.pair_ids[tag, k] = zlib.crc32(f"{tag}{x}|{y if tag == 'N' else words.spelled[y]}".encode()) % DIMS
        return got

    def mark_features(self, words: Words) -> list[tuple[int, list[str]]]:
        """Features of the words that a pattern matches."""
        out = []
        for i, (mark, _) in self.marks.items():
            flag = bool(self.labelled[i])
            kind = re.sub(r"\d+", "", mark)
            out.append((i, [f"m{mark}", f"k{kind}", f"K{kind}|{flag}", f"M{mark}|{flag}", f"W{kind}|{self.around[-1][i] and words.facts[self.around[-1][i]][7]}"]))
        return out

    def features(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(features by number, where those of each word begin), for training."""
        flat, owner = [], []
        places = [(self.around[k], np.arange(len(self.ids))) for k in (0, -1, 1, -2, 2)]
        has = np.flatnonzero(self.above >= 0)
        for k, (ids, at) in enumerate([*places, (self.above[has], has)]):
            listed = [w[k] for w in words.ids]
            sizes = np.array([len(x) for x in listed])
            begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            flat.append(np.array([x for f in listed for x in f], np.int32)[ranges(begin[ids], sizes[ids])])
            owner.append(np.repeat(at, sizes[ids]))
        for tag, keys in self.pairs:
            unique, inverse = np.unique(keys, return_inverse=True)
            flat.append(np.array([self.pair_feature(words, tag, k) for k in unique.tolist()], np.int32)[inverse])
            owner.append(np.arange(len(keys)))
        for i, names in self.mark_features(words):
            flat.append(np.array(_ids(names), np.int32))
            owner.append(np.full(len(names), i))
        owner = np.concatenate(owner)
        return np.concatenate(flat)[np.argsort(owner, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(self.ids)))))

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, kind): neighbours among the words of a document that share a key, or else their first letters."""
        out = []
        for keys, rest in ((self.key, 1), (self.stem, 2)):
            at = np.flatnonzero(keys >= 0)
            order = at[np.lexsort((at, keys[at], self.docs[at]))]
            a, b = order[:-1], order[1:]
            same = (keys[a] == keys[b]) & (self.docs[a] == self.docs[b])
            if rest == 2:
                same &= self.key[a] != self.key[b]
            a, b = a[same], b[same]
            out.append((a, b, np.where(self.form[a] == self.form[b], 0, 1) if rest == 1 else np.full(len(a), 2)))
        return tuple(np.concatenate(x) for x in zip(*out))


class Model:
    def __init__(self) -> None:
        self.weights = np.zeros((DIMS, len(LABELS)))
        self.trans = np.where(_allowed(), 0.0, -30.0)
        self.start = np.array([-30.0 if x[0] == "I" else 0.0 for x in LABELS])
        #: Log potentials of a skip edge of each kind whose ends are both O, or both of one type of entity; learned.
        self.skip = np.zeros((EDGES, 2))


def _allowed() -> np.ndarray:
    ok = np.ones((len(LABELS),) * 2, bool)
    for j, y in enumerate(LABELS):
        if y[0] == "I":
            for i, x in enumerate(LABELS):
                ok[i, j] = x[1:] == y[1:] and x != "O"
    return ok


#: The type of each label: 0 for O, else one more than its place in TYPES.
KINDS = np.array([0 if x == "O" else 1 + TYPES.index(x[2:]) for x in LABELS])


def compose(maker: Maker, good: list[str], bad: list[str], plain: list[str], sentences: int) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up document of ``sentences`` sentences, some of a line of their own, and its entities."""
    rng, text, ents = maker.rng, "", []
    maker.people = []
    bullet = rng.random() < 0.1
    for _ in range(sentences):
        k = rng.random()
        pattern = (maker.rule(True) if k < 0.2 else maker.pick(good)) if k < 0.45 else (maker.rule(False) if k < 0.55 else maker.pick(bad)) if k < 0.75 else maker.pick(plain)
        pieces = maker.fill(pattern.strip()) if k < 0.75 else [(pattern, None)]
        pieces = [(x if kind else maker.vary(x, 0.1 if k < 0.75 else 0.2), kind) for x, kind in pieces]
        whole = "".join(p for p, _ in pieces)
        if text:
            text += "\n" if "\n" in whole or len(whole.split()) < 5 or rng.random() < 0.5 else " "
        if bullet and (not text or text[-1] == "\n"):
            text += "- "
        for piece, kind in pieces:
            if kind:
                ents.append((len(text), len(text) + len(piece), kind))
            text += piece
        if "\n" in whole:
            text += "\n"
    if rng.random() < 0.05:
        text = text.upper()
    return text, ents


def gold_labels(batch: Batch, entities: list[list[tuple[int, int, str]]]) -> np.ndarray:
    gold = np.zeros(len(batch.ids), np.int64)
    for d, ents in enumerate(entities):
        first, last = np.searchsorted(batch.docs, [d, d + 1])
        for a, b, kind in ents:
            inside = first + np.flatnonzero((batch.starts[first:last] < b) & (batch.ends[first:last] > a))
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
    return gold


@lru_cache(maxsize=1)
def train(count: int = 5000, epochs: int = 3, rate: float = 0.3, decay: float = 1e-4, skip_docs: int = 150, skip_rounds: int = 10, seed: int = 11) -> Model:
    """Gradient ascent on the conditional likelihood of ``count`` made-up documents; the same each time. The potentials of skip
    edges are learned afterwards, by the gradient that message passing gives, on ``skip_docs`` longer documents, half of whose
    patterns the chains haven't seen, as on new texts."""
    rng = np.random.default_rng(seed)
    lists = [[x for x in t.split("\n") if x.strip()] for t in (PATTERNS, OTHERS)]
    plain = [s for lang in SENTENCES.values() for s in lang.split("\n")]
    maker = Maker(rng)
    # every sixth pattern is kept for the skip edges at first
    seen = [[x for i, x in enumerate(t) if i % 6] for t in lists]
    kept = [t[::6] for t in lists]
    model = Model()
    _climb(model, [compose(maker, *seen, plain, int(rng.integers(1, 6))) for _ in range(count // 4)], rng, epochs, rate, decay)
    _learn_skips(model, [compose(maker, [*maker.rng.permutation(seen[0])[: len(kept[0])], *kept[0]], [*maker.rng.permutation(seen[1])[: len(kept[1])], *kept[1]], plain, int(rng.integers(5, 14))) for _ in range(skip_docs)], skip_rounds)
    # then the chains learn the kept patterns too
    _climb(model, [compose(maker, *lists, plain, int(rng.integers(1, 6))) for _ in range(count)], rng, epochs, rate, decay)
    return model


def _climb(model: Model, docs: list, rng: np.random.Generator, epochs: int, rate: float, decay: float) -> None:
    words, n = Words(), len(LABELS)
    batch = Batch(words, [t for t, _ in docs])
    gold = gold_labels(batch, [e for _, e in docs])
    feats, begin = batch.features(words)
    sizes = np.diff(begin)
    free = _allowed()
    history = {k: np.full_like(getattr(model, k), 1.0 if k == "weights" else 10.0) for k in ("weights", "trans", "start")}
    lines = len(batch.lengths)
    total, steps = np.zeros_like(model.weights), 0
    for epoch in range(epochs):
        order = rng.permutation(lines)
        for at in range(0, lines, 120):
            chosen = order[at : at + 120]
            at_word = ranges(batch.first[chosen], batch.lengths[chosen])
            flat = feats[ranges(begin[at_word], sizes[at_word])]
            owner = np.repeat(np.arange(len(at_word)), sizes[at_word])
            emit = np.add.reduceat(model.weights[flat], np.concatenate(([0], np.cumsum(sizes[at_word])))[:-1], axis=0)
            lengths, y = batch.lengths[chosen], gold[at_word]
            pairs = [np.zeros((n, n))]
            gamma = marginals(emit, lengths, model.trans, model.start, pairs=pairs)
            diff = np.eye(n)[y] - gamma
            touched, inverse = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inverse, diff[owner, j], len(touched)) for j in range(n)], axis=1) - decay * len(chosen) * model.weights[touched]
            history["weights"][touched] += g**2
            model.weights[touched] += rate * g / np.sqrt(history["weights"][touched])
            firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            inner = np.ones(len(y), bool)
            inner[firsts] = False
            to = np.flatnonzero(inner)
            seen = np.zeros((n, n))
            np.add.at(seen, (y[to - 1], y[to]), 1)
            for name, g, ok in (("trans", seen - pairs[0], free), ("start", diff[firsts].sum(axis=0), model.start > -20)):
                history[name] += g**2
                getattr(model, name)[ok] += (rate * g / np.sqrt(history[name]))[ok]
            if epoch == epochs - 1:
                total += model.weights
                steps += 1
    # the mean over the last epoch wavers less than any single step
    model.weights[:] = total / max(steps, 1)


def _learn_skips(model: Model, docs: list, rounds: int, rate: float = 0.25) -> None:
    """Observed less expected agreement of the ends of each kind of edge, expectations by the pair beliefs."""
    words = Words(model.weights)
    batch = Batch(words, [t for t, _ in docs])
    kinds = KINDS[gold_labels(batch, [e for _, e in docs])]
    emit = batch.emissions(words)
    a, b, kind = batch.edges()
    same = kinds[a] == kinds[b]
    observed = np.stack([np.bincount(kind, same & (kinds[a] == 0), EDGES), np.bincount(kind, same & (kinds[a] > 0), EDGES)], axis=1)
    history = np.full((EDGES, 2), 1e-2)
    for _ in range(rounds):
        _, cavities = agree(model, batch, emit)
        left, right = cavities
        gain = np.exp(model.skip[kind])
        both = left * right
        o, e = gain[:, 0] * both[:, 0], gain[:, 1] * both[:, 1:].sum(axis=1)
        total = left.sum(axis=1) * right.sum(axis=1) - both.sum(axis=1) + o + e
        expected = np.stack([np.bincount(kind, o / total, EDGES), np.bincount(kind, e / total, EDGES)], axis=1)
        g = (observed - expected) / max(len(a), 1)
        history += g**2
        model.skip += rate * g / np.sqrt(history)


def agree(model: Model, batch: Batch, emit: np.ndarray, tolerance: float = 0.02, rounds: int = 50) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Marginals after loopy message passing along the skip edges, until no message moves by more than ``tolerance`` (in log),
    and the cavity beliefs of both ends of each edge. Messages are damped from the tenth round on, so that they settle;
    ``rounds`` only bounds a graph whose messages would swing for ever."""
    gamma = marginals(emit, batch.lengths, model.trans, model.start)
    a, b, kind = batch.edges()
    n = len(TYPES) + 1
    if not len(a):
        return gamma, (np.zeros((0, n)), np.zeros((0, n)))
    # the other way round as well: message i goes from source[i] to target[i], and i + len(a) comes back
    source, target, gain = np.concatenate([a, b]), np.concatenate([b, a]), np.exp(np.concatenate([model.skip[kind]] * 2))
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.full((len(source), n), 1.0 / n)
    spread_out = np.zeros((n, len(LABELS)))
    spread_out[KINDS, np.arange(len(LABELS))] = 1.0
    extra = np.zeros((len(emit), n))
    for step in range(rounds):
        belief = gamma @ spread_out.T
        cavity = belief[source] / message[back]
        cavity /= cavity.sum(axis=1, keepdims=True)
        new = 1.0 + (np.concatenate([gain[:, :1], np.repeat(gain[:, 1:], n - 1, axis=1)], axis=1) - 1.0) * cavity
        new /= new.sum(axis=1, keepdims=True)
        if step >= 10:
            new = np.sqrt(new * message)
            new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(np.log(new) - np.log(message)).max(axis=1) > tolerance
        message = new
        if not moved.any():
            break
        total = np.zeros_like(extra)
        np.add.at(total, target, np.log(message))
        extra = total
        lines = np.unique(batch.line[target[moved]])
        lengths = batch.lengths[lines]
        index = ranges(batch.first[lines], lengths)
        gamma[index] = marginals(emit[index] + extra[index] @ spread_out, lengths, model.trans, model.start)
    return gamma, (cavity[: len(a)], cavity[len(a) :])


def skip_key(w: str) -> str | None:
    """What repeated or similar words share: the letters of a word that may be part of a name; None for other words."""
    if any(c.isdigit() for c in w) or "@" in w or len(w) < 2:
        return None
    if not (w[0].isupper() or w[0] >= "\u0900"):
        return None
    return re.sub(r"['’]s$|[^\w\u0900-\u0dff]", "", w.lower()) or None


class Tagger:
    """Documents to spans; scores of words are remembered."""

    def __init__(self, model: Model, keep: int = 200_000) -> None:
        self.model, self.keep = model, keep
        self.words = Words(model.weights)

    def documents(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text its entities as (start, end, type)."""
        if len(self.words.number) > self.keep or len(self.words.pairs) > 5 * self.keep:
            self.words.clear()
        batch = Batch(self.words, texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not len(batch.ids):
            return out
        gamma, _ = agree(self.model, batch, batch.emissions(self.words))
        best = gamma.argmax(axis=1)
        for c in np.unique(batch.line[best > 0]):
            at = slice(batch.first[c], batch.first[c] + batch.lengths[c])
            d, begin = int(batch.docs[batch.first[c]]), batch.line_at[c]
            line = texts[d][begin : int(batch.ends[at][-1]) + 40].split("\n", 1)[0]
            spans = list(zip((batch.starts[at] - begin).tolist(), (batch.ends[at] - begin).tolist()))
            out[d] += [(begin + a, begin + b, kind) for a, b, kind in decode(line, spans, best[at])]
        return out


def decode(line: str, spans: list[tuple[int, int]], best: np.ndarray) -> list[tuple[int, int, str]]:
    """Entities of a line from the labels of its words, checked exactly."""
    groups: list[tuple[int, int, str]] = []
    for i, y in enumerate(best):
        if not y:
            continue
        kind = LABELS[y][2:]
        if groups and groups[-1][2] == kind and groups[-1][1] == i and LABELS[y][0] == "I":
            groups[-1] = (groups[-1][0], i + 1, kind)
        else:
            groups.append((i, i + 1, kind))
    out = []
    flat = line.translate(_DIGITS)
    for a, b, kind in groups:
        s, e = spans[a][0], spans[b - 1][1]
        if kind in ("email", "phone", "id_number"):
            pattern = {"email": EMAIL, "phone": PHONE, "id_number": IDENTITY}[kind]
            for m in pattern.finditer(flat):
                if m.start() < e and m.end() > s and well_formed(kind, m[0]):
                    out.append((m.start(), m.end(), kind))
        else:
            got = trim(line, s, e, kind)
            if got:
                out.append((*got, kind))
    return list(dict.fromkeys(out))


def well_formed(kind: str, x: str) -> bool:
    digits = sum(c.isdigit() for c in x)
    if kind == "phone":
        return 7 <= digits <= 14 and not re.fullmatch(r"\d{1,4}[-.]\d{1,2}[-.]\d{1,4}", x)
    return True


def trim(line: str, s: int, e: int, kind: str) -> tuple[int, int] | None:
    """An address from its house to its postal code or town, a name without its title."""
    x = line[s:e]
    if kind == "address":
        if not re.search(r"[\d०-९]", x):
            return None
    else:
        while m := _TITLES.match(x) or _SMALL.match(x):
            s += m.end()
            x = line[s:e]
        # a lone word in small letters is no name
        if len(re.sub(r"[\s.,'’-]", "", x)) < 2 or " " not in x and x.islower() or re.search(r"[\d\x80-\xbf]", x):
            return None
    return (s, e) if s < e else None


PLACEHOLDERS = {t: f"[{t.upper()}]" for t in TYPES}


def find_pii(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found: array of (start, end, type, text), redacted): the entities of each text that holds any, in code points,
    and the text with placeholders in their place."""
    model = train()
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    rows = spread(rows, "id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for f in frames:
            for at in range(0, len(f), 500):
                part = f.iloc[at : at + 500]
                texts = part["text"].tolist()
                out = []
                for i, t, ents in zip(part["id"], texts, tagger.documents(texts)):
                    if ents:
                        found = [{"start": a, "end": b, "pii_type": k, "pii_text": t[a:b]} for a, b, k in ents]
                        out.append((i, found, redact(t, ents)))
                yield pd.DataFrame(out, columns=["id", "found", "redacted"])

    return rows.mapInPandas(work, "id long, found array<struct<start:int,end:int,pii_type:string,pii_text:string>>, redacted string")


def redact(text: str, entities: list[tuple[int, int, str]]) -> str:
    """``text`` with each entity replaced by the placeholder of its type; of overlapping ones, the first and longest."""
    out, at = [], 0
    for a, b, kind in sorted(entities, key=lambda x: (x[0], -x[1])):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join(out) + text[at:]
