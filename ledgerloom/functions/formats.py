"""How values are shown, secrets that aren't, and what a content is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(c: Column, unit: int, name: str) -> Column:
    """``c`` in ``unit``, with one place, halves up, by whole numbers."""
    t = F.floor((c * 10 + unit // 2) / unit)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {name}"))


def size(c: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, _tenths(c, 1024, "KB")).otherwise(_tenths(c, 1024 * 1024, "MB"))


def duration(nanoseconds: Column) -> Column:
    """Nanoseconds as whole microseconds below a millisecond, else as milliseconds."""
    return F.when(nanoseconds < 1_000_000, F.concat(F.floor(nanoseconds / 1000).cast("string"), F.lit(" us"))).otherwise(_tenths(nanoseconds, 1_000_000, "ms"))


def confidence(c: Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit(" %"))


def badge(c: Column) -> Column:
    """The word for a confidence."""
    return F.when(c >= 0.9, "high").when(c >= 0.75, "good").when(c >= 0.5, "fair").when(c.isNotNull(), "low").otherwise("unknown")


def redact(c: Column, pattern: str) -> Column:
    """``c`` with what follows the first group of ``pattern`` taken out."""
    return F.regexp_replace(c, pattern, "$1[redacted]")


def content_format(c: Column) -> Column:
    """What a text really is: rich text, HTML, XML, mostly unprintable, or text."""
    x = F.ltrim(c)
    odd = F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]"))
    return (
        F.when(c.isNull() | (c == ""), "empty").when(x.startswith(r"{\rtf"), "rtf").when(F.lower(F.substring(x, 1, 200)).rlike("^<(!doctype html|html|body)"), "html").when(x.startswith("<?xml"), "xml")
        .when(odd > F.length(c) * F.lit(0.2), "binary").otherwise("text")
    )
