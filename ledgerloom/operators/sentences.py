"""Lossless sentence splitting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ABBREVIATIONS = frozenset("rs mr mrs ms dr smt shri no co ltd pvt bros st vs etc inc sec art cl ph opp".split())
_END = re.compile(r"[.!?।]+[\"'”’)]*(\s+|$)")


def pieces(text: str) -> list[tuple[str, str]]:
    """(sentence, separator) pairs that joined give ``text``; abbreviations, initials and decimals end no sentence."""
    out, at = [], 0
    for m in _END.finditer(text):
        head = text[at : m.start()]
        word = re.search(r"([^\W\d_]+)$", head)
        after = text[m.end() : m.end() + 1]
        if m[0][0] == "." and word and (word[1].lower() in _ABBREVIATIONS or len(word[1]) == 1 and word[1].isupper()):
            continue
        if m[0][0] == "." and (after.islower() or after.isdigit()):
            continue
        end = m.end() - len(m[1] or "")
        out.append((text[at:end], m[1] or ""))
        at = m.end()
    if at < len(text):
        out.append((text[at:], ""))
    return out


def split(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, sentence_no, sentence, separator). Null and empty texts have no sentences."""
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind = dict(rows.dtypes)["id"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, n, s, sep) for i, t in zip(f["id"], f["text"]) for n, (s, sep) in enumerate(pieces(t))]
            yield pd.DataFrame(out, columns=["id", "sentence_no", "sentence", "separator"])

    return rows.mapInPandas(work, f"id {kind}, sentence_no int, sentence string, separator string").withColumnRenamed("id", id)
