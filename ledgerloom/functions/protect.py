"""Entities kept whole through a rewrite, glossaries, harmonised wording, transliteration and text units."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.text import any_script
from ledgerloom.operators.sentences import pieces

#: What is kept, by precedence.
KEEP = (
    ("URL", r"https?://\S+|www\.\S+"), ("EMAIL", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), ("DATE", r"\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b"), ("ID", r"\b(?=\w*\d)(?=\w*[A-Za-z])[\w/-]{4,}\b"),
    ("MONEY", r"(?:₹|Rs\.?|INR)\s*\d[\d,]*(?:\.\d+)?"), ("PERCENT", r"\d+(?:\.\d+)?\s*%"), ("NUMBER", r"\d[\d,]*(?:\.\d+)?"),
)
_ANY = re.compile("|".join(f"(?P<{n}>{p})" for n, p in KEEP))
#: What words of terms are made of; any other character ends one.
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
HONORIFICS = r"(?:Shri|Smt|Mr|Mrs|Ms|Dr|Justice|Advocate|श्री|श्रीमती|डॉ)\.?"
#: Variants of wording and the one that is used.
HARMONISED = ((r"\bcheque\s*book\b", "chequebook"), (r"\bpass\s*book\b", "passbook"), (r"\be-?mail\b", "email"), (r"\bA/c\b", "account"), (r"\bRs\.?\s*(?=\d)", "INR "))
_ROMAN = [("chh", "छ"), ("ksh", "क्ष"), ("kh", "ख"), ("gh", "घ"), ("ch", "च"), ("jh", "झ"), ("th", "थ"), ("dh", "ध"), ("ph", "फ"), ("bh", "भ"), ("sh", "श"), *zip("kgjtdnpbmyrlvwshfzq", "कगजतदनपबमयरलववसहफजक")]
_VOWELS = [("aa", "आ", "ा"), ("ee", "ई", "ी"), ("oo", "ऊ", "ू"), ("ai", "ऐ", "ै"), ("au", "औ", "ौ"), ("a", "अ", ""), ("i", "इ", "ि"), ("u", "उ", "ु"), ("e", "ए", "े"), ("o", "ओ", "ो")]


def protect(text: str) -> tuple[str, list[dict]]:
    """(text with placeholders, spans); ``restore`` undoes it."""
    spans: list[dict] = []

    def keep(m: re.Match) -> str:
        spans.append({"placeholder": f"⟦{m.lastgroup}{len(spans)}⟧", "value": m[0]})
        return spans[-1]["placeholder"]

    return _ANY.sub(keep, text), spans


def restore(text: str, spans: list[dict]) -> tuple[str, list[str]]:
    """(text with the values back, placeholders that were lost or doubled)."""
    bad = [s["placeholder"] for s in spans if text.count(s["placeholder"]) != 1]
    for s in spans:
        text = text.replace(s["placeholder"], s["value"])
    return text, bad


def transliterate(word: str) -> str:
    """A romanised word in Devanagari, by longest match."""
    out, i, after = [], 0, False
    x = word.lower()
    while i < len(x):
        for k, v in _ROMAN:
            if x.startswith(k, i):
                out.append(("्" if after else "") + v)
                i, after = i + len(k), True
                break
        else:
            for k, full, sign in _VOWELS:
                if x.startswith(k, i):
                    out.append(sign if after else full)
                    i, after = i + len(k), False
                    break
            else:
                out.append(x[i])
                i, after = i + 1, False
    return "".join(out)


def glossary_pattern(terms: dict[str, str]) -> re.Pattern:
    return re.compile("|".join(re.escape(k) for k in sorted(terms, key=len, reverse=True)))


def standing(text: str, term: str) -> Iterator[int]:
    """Where ``term`` stands as whole words, from left to right. The character after one belongs to it, so that another one right
    behind that character isn't found."""
    i, free = text.find(term), 0
    while i >= 0:
        end = i + len(term)
        if (i == 0 or i > free and text[i - 1] not in _WORD) and (end == len(text) or text[end] not in _WORD):
            yield i
            i = free = end + 1
        else:
            i += 1
        i = text.find(term, i)


def terms_in(text: str, terms: Sequence[str]) -> list[str]:
    """The terms (small letters, longest first) in a text; one of several words takes them from those after it."""
    # of İ, lower() would make two characters
    rest, found = text.replace("İ", "i").lower(), []
    for t in terms:
        if " " not in t:
            found += [t for _ in islice(standing(rest, t), 1)]
        elif at := [*standing(rest, t)]:
            found.append(t)
            rest = "#".join(rest[a:b] for a, b in zip([0, *(i + len(t) for i in at)], [*at, len(rest)]))
    return found


def glossary_terms(c: Column, terms: Sequence[str]) -> Column:
    """``terms_in`` of each text, with commas between them; none of a null."""

    @F.pandas_udf(StringType())
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([",".join(terms_in(x.decode(errors="replace"), terms)) if x is not None else "" for x in texts], dtype=object)

    return found(c.cast("binary"))


def clauses(text: str, most: int = 3500) -> list[str]:
    """Paragraphs packed from whole sentences up to ``most`` characters; joined they give ``text``."""
    out: list[str] = []
    for para in re.split(r"(?<=\n)\n+", text):
        current = ""
        for s, sep in pieces(para):
            if current and len(current) + len(s) > most:
                out.append(current)
                current = ""
            current += s + sep
        out.append(current)
    return [x for x in out if x]


def chunks(sentence: str, most: int = 64) -> list[str]:
    """A long sentence in parts of at most ``most`` words."""
    words = sentence.split(" ")
    return [" ".join(words[i : i + most]) for i in range(0, len(words), most)]


def word_error_rate(a: str, b: str) -> float | None:
    x, y = a.split(), b.split()
    if not x:
        return None
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        prev, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != q))
    return row[-1] / len(x)


def script_segments(text: str) -> list[tuple[str, str]]:
    """(script, piece) runs of Devanagari, Latin and other letters; neutral characters stick to the run before them."""
    out: list[list[str]] = []
    for ch in text:
        kind = "deva" if "ऀ" <= ch <= "ॿ" else "latin" if ch.isascii() and ch.isalpha() else None
        if out and (kind is None or kind == out[-1][0]):
            out[-1][1] += ch
        else:
            out.append([kind or "neutral", ch])
    return [(a, b) for a, b in out]


def harmonise(c: Column) -> Column:
    for pattern, word in HARMONISED:
        c = F.regexp_replace(c, f"(?iu){any_script(pattern)}", word)
    return c


def clean_legal(c: Column) -> Column:
    """Blanks of a detokeniser taken out around punctuation, brackets and slashes."""
    c = F.regexp_replace(c, any_script(r"\s+([,.;:)\]])"), "$1")
    c = F.regexp_replace(c, any_script(r"([(\[])\s+"), "$1")
    return F.regexp_replace(c, any_script(r"\s*/\s*"), "/")


def apply_rows(df: DataFrame, id: str, text: str, schema: str, f) -> DataFrame:
    """Rows (id, ...) that ``f(text)`` gives for each text, in Arrow batches; null texts give none."""
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    kind = dict(rows.dtypes)["id"]
    names = ["id", *[x.split()[0] for x in schema.split(", ")]]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fr in frames:
            yield pd.DataFrame([(i, *r) for i, t in zip(fr["id"], fr["text"]) for r in f(t)], columns=names)

    return rows.mapInPandas(work, f"id {kind}, {schema}").withColumnRenamed("id", id)
