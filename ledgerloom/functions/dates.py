"""Dates and times of day in cells: ISO forms, then the formats of statements, day before month."""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: In the order in which they are tried.
DATES = ("%d/%m/%Y", "%Y/%m/%d", "%d/%m/%y", "%d %b %Y", "%d %B %Y", "%d-%b-%Y", "%d-%B-%Y", "%Y-%m-%d", "%d%m%Y")
TIMES = ("%H:%M:%S", "%I:%M:%S %p", "%H:%M", "%I:%M %p")
#: A time of day with a fraction or zone behind it.
_LED = re.compile(r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]")
_LED_12 = re.compile(r"((?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9])?)(?:\.[0-9]+)? ?([AaPp][Mm])(?![A-Za-z])")


def _first(candidates: list[str], formats: tuple[str, ...]) -> datetime | None:
    for text in candidates:
        for form in formats:
            try:
                return datetime.strptime(text, form)
            except ValueError:
                pass
    return None


def _iso(text: str) -> datetime | None:
    try:
        return datetime.fromisoformat(text)
    except ValueError:
        return None


def _slashed(text: str) -> str:
    return text.replace(".", "/").replace("-", "/")


@lru_cache(1 << 16)
def date_of(cell: str | None) -> str | None:
    x = "" if cell is None else cell.strip().replace("\n", "").replace("\xa0", " ").strip("\"'")
    if not x:
        return None
    candidates = [x, _slashed(x)]
    if ":" in x and x.split():
        candidates += [x.split()[0], _slashed(x.split()[0])]
    found = _iso(x) or _first(candidates, DATES)
    return found and found.date().isoformat()


@lru_cache(1 << 16)
def time_of(cell: str | None) -> str | None:
    x = "" if cell is None else cell.strip()
    if not x:
        return None
    found = (_iso(x) if " " in x or "T" in x else None) or _first([x, *x.split()[-1:]], TIMES)
    if found is None and (m := _LED_12.match(x)):
        found = _first([f"{m[1]} {m[2]}"], TIMES)
    if found is not None:
        return found.strftime("%H:%M:%S")
    return m[0] if (m := _LED.match(x)) else None


@F.pandas_udf(StringType())
def parse_date(cells: pd.Series) -> pd.Series:
    """Days as YYYY-MM-DD, null where no format fits."""
    return pd.Series([date_of(c) for c in cells], dtype=object)


@F.pandas_udf(StringType())
def parse_time(cells: pd.Series) -> pd.Series:
    """Times as HH:MM:SS, null where no format fits; fractions and zones are dropped."""
    return pd.Series([time_of(c) for c in cells], dtype=object)
