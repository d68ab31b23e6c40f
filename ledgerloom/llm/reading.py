"""The level of reading that each English text demands.

One smoothed unigram language model per level is trained on the labelled texts; a text gets the level with the highest
posterior. Words are compared in small letters; numbers, addresses and words in capitals or unknown to all models say
nothing. As an addition to the words, each model holds a mark for the length of the sentence that each of them stands in
(``marks``), since easy words in long sentences aren't easy to read.

A level without any labelled text is seeded by a readability formula: texts of the corpus whose grade by word and sentence
length falls into the level's band train its model.

Defined results: texts not wholly in English, null and blank ones, and those of fewer than ``least_words`` words get no
level. Labels given twice for a text count once, with the lower level; a text given twice under one id is a sample once.
Without any labelled text all levels are seeded; without any text to seed from either, every level is as likely as any other,
and the easiest is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.encoding import Detector
from ledgerloom.llm.language import _END, _ODD, Labeller, decide
from ledgerloom.llm.language import train as train_language
from ledgerloom.session import spread

_WORD = re.compile(r"[a-z][a-z'’]*")
_CAPITAL = re.compile(r"(?<=[a-z,;] )[A-Z][\w'’-]*")


#: Upper bounds of the buckets of sentence length, in words.
_LENGTHS = (4, 8, 13, 20, 30, 45)


#: Grades of the formula from which on a text belongs to the second, third and so on of the levels.
BANDS = (5.0, 9.0, 13.0)


def words(text: str, marks: bool = True) -> list[str]:
    """What tells the level of ``text``: its words (capitals inside a sentence are names) and, with ``marks``, for each word the
    length of its sentence."""
    out = []
    for line in text.split("\n"):
        for s in _END.split(line):
            got = [w for w in _WORD.findall(_CAPITAL.sub(" ", s).lower()) if len(w) > 1 or w in "ai"]
            out += got
            if marks and len(got) > 2:
                out += [f"<{bisect_left(_LENGTHS, len(got))}>"] * len(got)
    return out


def grade(text: str) -> float:
    """The school grade of ``text`` by the Flesch-Kincaid formula: words per sentence and syllables per word."""
    sentences = [w for line in text.split("\n") for s in _END.split(line) if (w := re.findall(r"[a-z]+", s.lower()))]
    count = sum(map(len, sentences))
    if not count:
        return 0.0
    syllables = sum(max(1, len(re.findall(r"[aeiouy]+", w)) - (w.endswith("e") and not w.endswith("le"))) for s in sentences for w in s)
    return 0.39 * count / len(sentences) + 11.8 * syllables / count - 15.59


class Levels:
    """Unigram models with additive smoothing over the words of all levels."""

    def __init__(self, samples: list[tuple[str, int]], levels: tuple[int, ...], smoothing: float = 0.1, marks: bool = True) -> None:
        self.levels, self.marks = levels, marks
        counts = {k: Counter() for k in levels}
        docs = Counter()
        for text, level in samples:
            if level in counts:
                counts[level].update(words(text, marks))
                docs[level] += 1
        self.vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts.values())))}
        table = np.full((len(self.vocabulary) + 1, len(levels)), smoothing)
        for k, level in enumerate(levels):
            for w, n in counts[level].items():
                table[self.vocabulary[w], k] += n
        logs = np.log(table / table.sum(axis=0, keepdims=True))
        logs[-1] = 0.0
        self.logs = logs
        self.prior = np.log(np.array([docs[k] + 1.0 for k in levels]))

    def posterior(self, text: str) -> np.ndarray:
        ids = [self.vocabulary[w] for w in words(text, self.marks) if w in self.vocabulary]
        score = self.prior + (self.logs[ids].sum(axis=0) if ids else 0.0)
        p = np.exp(score - score.max())
        return p / p.sum()

    def level(self, text: str) -> tuple[int, float]:
        p = self.posterior(text)
        k = int(p.argmax())
        return self.levels[k], float(p[k])


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, level: str, max_labelled: int = 3000, max_chars: int = 20_000, levels: tuple[int, ...] = (1, 2, 3, 4)) -> Levels:
    """Models trained on the ``max_labelled`` labelled texts with the smallest ids, of ``max_chars`` code points at most (so that
    the driver gets 60 million at most); levels without any are seeded by the formula, from as many unlabelled texts."""
    known = labels.select(F.col(id), F.col(level).cast("int").alias("level")).where(F.col(id).isNotNull() & F.col(level).isin(*levels)).groupBy(id).agg(F.min("level").alias("level"))
    known = known.orderBy(id).limit(max_labelled)
    usable = docs.select(id, F.col(text).alias("text")).where(F.col(id).isNotNull() & (F.length("text").between(1, max_chars)))
    rows = usable.join(F.broadcast(known), id).groupBy(id).agg(F.min("text").alias("text"), F.min("level").alias("level"))
    detector = Detector()
    clean = lambda t: detector.text(t)[1] if _ODD.search(t) else t
    samples = [(clean(r.text), r.level) for r in sorted(rows.collect(), key=lambda r: r[id])]
    missing = set(levels) - {k for _, k in samples}
    if missing:
        labeller = Labeller(train_language())
        texts = [clean(r.text) for r in usable.orderBy(id).limit(max_labelled).collect()]
        for t, lines in zip(texts, labeller.lines(texts)):
            band = levels[min(bisect_left(BANDS, grade(t)), len(levels) - 1)]
            if band in missing and [x[:2] for x in decide(lines)] == [(-1, "en")]:
                samples.append((t, band))
    return Levels(samples, levels)


def assign_levels(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", level: str = "level", least_words: int = 60, max_labelled: int = 3000) -> DataFrame:
    """(id, level, confidence) of each text wholly in English with at least ``least_words`` words between white space."""
    models, language = fit(docs, labels, id, text, level, max_labelled), train_language()
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(
        F.col("id").isNotNull() & (F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")) >= least_words)
        # texts mostly in another script aren't labelled by words first
        & (F.regexp_count("text", F.lit(r"[\x{0900}-\x{0DFF}]")) * 2 <= F.length("text"))
    )

    rows = spread(rows, "id")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller, detector = Labeller(language), Detector()
        for f in frames:
            for at in range(0, len(f), 1000):
                part = f.iloc[at : at + 1000]
                texts = [detector.text(t)[1] if _ODD.search(t) else t for t in part["text"]]
                out = []
                for i, t, lines in zip(part["id"], texts, labeller.lines(texts)):
                    got = decide(lines)
                    if len(got) == 1 and got[0][:2] == (-1, "en"):
                        out.append((i, *models.level(t)))
                yield pd.DataFrame(out, columns=["id", "level", "confidence"])

    return rows.mapInPandas(work, "id long, level int, confidence double")
