"""The language of each document and of each stretch of a mixed one, with a confidence.

A linear-chain conditional random field labels words: affix, character n-gram and lexicon features give each word a score
for each language, learned transitions link neighbours, and forward-backward gives each word its marginals. A chain is a
whole line; the step across the end of a sentence has transitions of its own, which are learned like those inside a
sentence. It is trained by gradient ascent on code-switched sequences made from the seed texts, the same each time.

Stretches are read off the decoded labels. A sentence has the language that most of its telling words are decoded as
(numbers, references and names without any score of their own tell little); its confidence is the mass of their marginals
as a share of all. Sentences too short to tell are no evidence.

Defined results: null and blank texts, and texts without any telling sentence, get no language. Garbled words are restored
first, where they can be. Lines are judged once per batch and remembered; that changes no result. Lines of any length are
labelled whole, in batches and blocks of bounded size.
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
from ledgerloom.llm.encoding import Detector
from ledgerloom.llm.seeds import LEXICON, SENTENCES
from ledgerloom.session import spread

LANGUAGES = tuple(SENTENCES)
DIMS = 1 << 15
#: Names of languages by code, in the notations that labels are written in.
NAMES: dict[str, str] = {
    name: code
    for code, names in {
        "en": "en eng english", "hi": "hi hin hindi हिन्दी हिंदी", "mr": "mr mar marathi मराठी", "ne": "ne nep npi nepali नेपाली",
        "gu": "gu guj gujarati ગુજરાતી", "ta": "ta tam tamil தமிழ்", "fr": "fr fra fre french français francais", "de": "de deu ger german deutsch",
    }.items()
    for name in names.split()
}
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*|[ऀ-ॣ॰-ॿ]+|[઀-૥]+|[஀-௥]+|[ঀ-৿਀-੿଀-୿ఀ-ൿ]+")
#: A sentence ends before white space and something that can begin one; not after initials and common short forms.
_END = re.compile(
    r"(?<=[.।?!])(?<!\b[A-Z]\.)(?<!\bRs\.)(?<!\bNo\.)(?<!\bCo\.)(?<!\bDr\.)(?<!\bMr\.)(?<!\bMrs\.)(?<!\bMs\.)(?<!\bSt\.)(?<!\bBros\.)(?<!\bLtd\.)"
    r"(?<!\bPvt\.)(?<!\bSmt\.)(?<!\bShri\.)(?<!\bPh\.)\s+(?=[^\sa-z0-9₹])|(?<=।)"
)
_NUMBER = re.compile(r"\d(?:[\d,./:-]*\d)?")
_ADDRESS = re.compile(r"(?<!\S)\S*@\S*|\bhttps?://\S+|\b(?:sd|c)/[-o]")
#: The same one by one, each with what a text must hold for it; one pattern for all is slow on long texts.
_PLAIN = ((re.compile(r"(?<!\S)\S*@\S*"), ("@",)), (re.compile(r"\bhttps?://\S+"), ("://",)), (re.compile(r"\b(?:sd|c)/[-o]"), ("sd/-", "sd/o", "c/o", "c/-")))
#: An address with its signs written out; looked for only in lines that hold such a sign.
_SIGN = re.compile(r" AT |[\[(]at[\])]")
_SPELLED = re.compile(r"[\w.+-]+ ?(?:AT|[\[(]at[\])]) ?[\w-]+(?:(?:\.| ?(?:DOT|[\[(]dot[\])]) ?)[\w-]+)+")
#: Whether a text can hold garbled words at all.
_ODD = re.compile("[^\x00-\x7fऀ-෿“”‘’–—…₹€£‌‍]")


def label_code(label: str | None) -> str | None:
    """The language a label names, in any notation; None if it names none."""
    if label is None:
        return None
    x = label.strip().casefold()
    return NAMES.get(x) or NAMES.get(re.split(r"[-_ ]", x)[0])


def _features(word: str) -> list[int]:
    low = word.lower().replace("’", "'")
    padded = f"^{low}$"
    names = [f"w{low}", *(f"p{low[:i]}" for i in (1, 2, 3)), *(f"s{low[-i:]}" for i in (1, 2, 3)), f"u{ord(low[0]) >> 7}"]
    names += [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]
    names += [f"l{lang}" for lang, words in _LEXICON.items() if low in words]
    return [zlib.crc32(n.encode()) % DIMS for n in names]


_LEXICON = {lang: frozenset(w.lower() for w in words.split()) for lang, words in LEXICON.items()}


class Model:
    """Weights of word features, transitions inside and across sentences, and starts."""

    def __init__(self) -> None:
        self.weights = np.zeros((DIMS, len(LANGUAGES)), np.float64)
        self.trans = np.zeros((len(LANGUAGES),) * 2)
        self.across = np.zeros((len(LANGUAGES),) * 2)
        self.start = np.zeros(len(LANGUAGES))

    def score(self, word: str) -> np.ndarray:
        f = _features(word)
        return self.weights[f].sum(axis=0) / np.sqrt(len(f))


def _sequences(rng: np.random.Generator, count: int) -> list[tuple[list[str], list[int], list[bool]]]:
    """Code-switched training chains of one to four stretches, each a piece of a seed sentence: (words, languages, whether a
    word begins a sentence). Most stretches begin a sentence of their own; some switches happen inside one. Foreign names
    occur in any language."""
    pool = [[_TOKEN.findall(s) for line in SENTENCES[lang].split("\n") for s in _END.split(line)] for lang in LANGUAGES]
    pool = [[s for s in p if len(s) > 1] for p in pool]
    out = []
    for _ in range(count):
        words: list[str] = []
        labels: list[int] = []
        begins: list[bool] = []
        k = int(rng.integers(len(LANGUAGES)))
        for part in range(int(rng.integers(1, 5))):
            if part and rng.random() < 0.4:
                k = int(rng.integers(len(LANGUAGES)))
            s = pool[k][int(rng.integers(len(pool[k])))]
            if rng.random() < 0.5:
                cut = int(rng.integers(0, max(1, len(s) - 3)))
                s = s[cut : cut + int(rng.integers(3, 14))]
            if rng.random() < 0.3:
                name = "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 5)))).title()
                at = int(rng.integers(len(s) + 1))
                s = [*s[:at], name, *s[at:]]
            begins += [part > 0 and rng.random() < 0.85] + [False] * (len(s) - 1)
            words += s
            labels += [k] * len(s)
        out.append((words, labels, begins))
    return out


@lru_cache(maxsize=1)
def train(count: int = 1600, epochs: int = 5, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Model:
    """Gradient ascent on the conditional likelihood of ``count`` chains, features and transitions at one rate; the same each
    time."""
    rng = np.random.default_rng(seed)
    data = _sequences(rng, count)
    model, n = Model(), len(LANGUAGES)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _, _ in data for w in words))}
    feats = [np.array(_features(w)) for w in vocabulary]
    sizes = np.array([len(f) for f in feats])
    norm = 1 / np.sqrt(sizes)
    flat, owner, begin = np.concatenate(feats), np.repeat(np.arange(len(feats)), sizes), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    chains = [(np.array([vocabulary[w] for w in words]), np.array(labels), np.array(begins)) for words, labels, begins in data]
    learned = {"weights": model.weights, "trans": model.trans, "across": model.across, "start": model.start}
    history = {k: np.full_like(v, 1e-2) for k, v in learned.items()}
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 100):
            batch = [chains[i] for i in order[at : at + 100]]
            ids, gold, cross = (np.concatenate([c[i] for c in batch]) for i in range(3))
            lengths = np.array([len(c[0]) for c in batch])
            scores = np.add.reduceat(model.weights[flat], begin, axis=0) * norm[:, None]
            pairs = [np.zeros((n, n)), np.zeros((n, n))]
            gamma = marginals(scores[ids], lengths, model.trans, model.start, model.across, cross, pairs)
            diff = np.eye(n)[gold] - gamma
            by_word = np.zeros((len(vocabulary), n))
            np.add.at(by_word, ids, diff)
            by_feature = (by_word * norm[:, None])[owner]
            grad = {"weights": np.stack([np.bincount(flat, by_feature[:, j], DIMS) for j in range(n)], axis=1) - decay * len(batch) * model.weights}
            firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            inner = np.ones(len(ids), bool)
            inner[firsts] = False
            for k, name in enumerate(("trans", "across")):
                seen = np.zeros((n, n))
                to = np.flatnonzero(inner & (cross == bool(k)))
                np.add.at(seen, (gold[to - 1], gold[to]), 1)
                grad[name] = seen - pairs[k] - decay * len(batch) * learned[name]
            grad["start"] = diff[firsts].sum(axis=0)
            for k, g in grad.items():
                history[k] += g**2
                learned[k] += rate * g / np.sqrt(history[k])
    return model


class Labeller:
    """Lines to their sentences with (language, confidence), a batch at a time, remembered."""

    def __init__(self, model: Model, keep: int = 300_000) -> None:
        self.model, self.keep = model, keep
        self.words: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES)))
        self.parts: dict[str, tuple[np.ndarray, bool]] = {}
        self.known: dict[str, list[tuple[str, str, float, bool, int]]] = {}

    def _word(self, w: str) -> int:
        i = self.words.get(w)
        if i is None:
            i = self.words[w] = len(self.words)
            if i >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[i] = self.model.score(w)
        return i

    def _part(self, sentence: str) -> tuple[np.ndarray, bool]:
        """(words by number, whether it is a whole sentence)."""
        got = self.parts.get(sentence)
        if got is None:
            words = _TOKEN.findall(sentence)
            got = self.parts[sentence] = (np.array([self._word(w) for w in words], np.int64), whole_sentence(words))
        return got

    def chains(self, ids: list[np.ndarray], per_line: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, how much each word tells, number of its sentence) of all words of sentences ``ids``, so many of which make
        a line; a word tells as much as its own scores spread."""
        sizes = np.array([len(x) for x in ids], np.int64)
        per_line = np.array(per_line)
        lengths = np.add.reduceat(sizes, np.cumsum(per_line) - per_line)
        emit = self.scores[np.concatenate(ids)]
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        cross = np.zeros(len(emit), bool)
        cross[1:] = sentence[1:] != sentence[:-1]
        gamma = marginals(emit, lengths, self.model.trans, self.model.start, self.model.across, cross)
        order = np.partition(emit, -2, axis=1)
        return gamma, np.minimum(order[:, -1] - order[:, -2], 2.0), sentence

    def learn(self, lines: list[str]) -> None:
        """Judges lines not known yet."""
        if len(self.known) > self.keep:
            self.known.clear()
        if len(self.words) > self.keep or len(self.parts) > self.keep:
            self.words.clear()
            self.parts.clear()
        todo = [x for x in dict.fromkeys(lines) if x not in self.known]
        if not todo:
            return
        cut = [_END.split(x) for x in todo]
        parts = [self._part(s) for c in cut for s in c]
        count = len(parts)
        mass, decoded, telling = np.zeros((count, len(LANGUAGES))), np.zeros((count, len(LANGUAGES))), np.zeros(count)
        if any(len(p[0]) for p in parts):
            gamma, tells, sentence = self.chains([p[0] for p in parts], [len(c) for c in cut])
            best = gamma.argmax(axis=1)
            # words of a sentence stand together, so sums over it are sums over a range
            has, first = np.unique(sentence, return_index=True)
            weighted = gamma * tells[:, None]
            mass[has] = np.add.reduceat(weighted, first, axis=0)
            weighted[np.arange(len(LANGUAGES))[None, :] != best[:, None]] = 0.0
            decoded[has] = np.add.reduceat(weighted, first, axis=0)
            telling = np.bincount(sentence, tells > 0.5, count)
        total, top = mass.sum(axis=1), decoded.argmax(axis=1)
        sure = mass[np.arange(count), top] / np.maximum(total, 1e-300)
        usable = (telling >= 2) & (total > 0)
        at = 0
        for x, sentences in zip(todo, cut):
            out = []
            for s in sentences:
                if usable[at]:
                    out.append((s, LANGUAGES[top[at]], float(sure[at]), parts[at][1], len(s)))
                at += 1
            self.known[x] = out

    def lines(self, texts: list[str]) -> list[list[list[tuple[str, str, float, bool, int]]]]:
        """For each text, for each line, its telling sentences as (sentence, language, confidence, whole, letters)."""
        plain = list(texts)
        for pattern, marks in _PLAIN:
            plain = [pattern.sub(" ", t) if any(m in t for m in marks) else t for t in plain]
        plain = ["\n".join(_SPELLED.sub(" ", x) if _SIGN.search(x) else x for x in t.split("\n")) if _SIGN.search(t) else t for t in plain]
        cut = [_NUMBER.sub("0", t).split("\n") for t in plain]
        self.learn([line for t in cut for line in t if line.strip()])
        return [[self.known[line] if line.strip() else [] for line in t] for t in cut]

    def segments(self, line: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of each stretch of ``line`` whose words are decoded as one language, however it
        is cut into sentences; words that tell nothing go with those before them."""
        spans, words = [], []
        hidden = _ADDRESS.sub(lambda m: " " * len(m[0]), line)
        at = 0
        for cut in [*(m.span() for m in _END.finditer(hidden)), (len(line), len(line))]:
            found = list(_TOKEN.finditer(hidden, at, cut[0]))
            spans += [m.span() for m in found]
            words.append([m[0] for m in found])
            at = cut[1]
        if not spans:
            return []
        gamma, tells, _ = self.chains([np.array([self._word(w) for w in s], np.int64) for s in words], [len(words)])
        best = gamma.argmax(axis=1)
        out: list[list] = []
        for (a, b), k, g, t in zip(spans, best, gamma, tells):
            if out and (out[-1][2] == k or t <= 0.5):
                out[-1][1] = b
                out[-1][3] += [g[out[-1][2]]] * bool(t > 0.5)
            else:
                out.append([a, b, k, [g[k]]])
        return [(a, b, LANGUAGES[k], float(np.mean(g))) for a, b, k, g in out]


def whole_sentence(words: list[str]) -> bool:
    """Whether ``words`` are more than names, signs and references: three words or more, two of them of some length and
    without a capital."""
    return len(words) >= 3 and sum(len(w) > (2 if w[0] < "ऀ" else 1) and not w[0].isupper() for w in words) >= 2


def label_texts(df: DataFrame, id: str, text: str, label: str, segments: bool = True) -> DataFrame:
    """(id, line_no, lang, confidence, label_code): a row with line_no -1 for a text in one language; for a text with
    whole sentences of several, a row for each line and language (without ``segments``, always one row for the language
    that most of it is in). Confidence is the mean over the sentences."""
    model = train()
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.col(label).alias("label")).where(
        F.col("id").isNotNull() & (F.trim("text") != "")
    )
    rows = spread(rows, "id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller, detector = Labeller(model), Detector()
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                texts = [detector.text(t)[1] if _ODD.search(t) else t for t in part["text"]]
                out = []
                for i, given, lines in zip(part["id"], part["label"], labeller.lines(texts)):
                    code = label_code(given)
                    for line_no, lang, sure in decide(lines, segments):
                        out.append((i, line_no, lang, sure, code))
                yield pd.DataFrame(out, columns=["id", "line_no", "lang", "confidence", "label_code"])

    return rows.mapInPandas(work, "id long, line_no int, lang string, confidence double, label_code string")


def label_segments(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, start, end, lang, confidence): every stretch of each line, in code points, with its language."""
    model = train()
    rows = spread(df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.trim("text") != "")), "id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model)
        for f in frames:
            for i, t in zip(f["id"], f["text"]):
                if len(labeller.words) > labeller.keep:
                    labeller.words.clear()
                    labeller.parts.clear()
                out = [(i, n, *x) for n, line in enumerate(t.split("\n")) for x in labeller.segments(line)]
                yield pd.DataFrame(out, columns=["id", "line_no", "start", "end", "lang", "confidence"])

    return rows.mapInPandas(work, "id long, line_no int, start int, end int, lang string, confidence double")


def decide(lines: list[list[tuple[str, str, float, bool, int]]], segments: bool = True, least: float = 0.7) -> list[tuple[int, str, float]]:
    """(line_no, language, confidence) of a text, from its telling sentences by line. ``least``: confidence from which a
    whole sentence shows that its language is there."""
    mass: dict[str, float] = {}
    firm: set[str] = set()
    for line in lines:
        for _, lang, sure, whole, size in line:
            mass[lang] = mass.get(lang, 0.0) + sure * size
            if whole and sure >= least:
                firm.add(lang)
    if not mass:
        return []
    if len(firm) < 2 or not segments:
        best = max(mass, key=lambda k: (k in firm, mass[k]))
        return [(-1, best, mass[best] / sum(mass.values()))]
    out = []
    for n, line in enumerate(lines):
        found: dict[str, list[float]] = {}
        for _, lang, sure, whole, _ in line:
            if lang in firm and whole and sure >= least:
                found.setdefault(lang, []).append(sure)
        out += [(n, lang, float(np.mean(v))) for lang, v in found.items()]
    return out
