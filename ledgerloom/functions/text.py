"""Text expressions: spacing, scripts, facts, critical spans, usability, edit distances."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEVANAGARI_DIGITS = "०१२३४५६७८९"
#: Marker words of languages written in Devanagari.
MARATHI = ("आहे", "आणि", "नाही", "झाली", "केला", "आम्ही", "तुमची", "तुमचा")
NEPALI = ("छ", "भएको", "गर्नुहोस्", "तपाईंको", "हामीले", "गरेको", "अहिले", "छैन")
HINDI = ("है", "हैं", "और", "में", "नहीं", "कर", "आपके", "हमने")
#: Beginning and end of a word, for patterns that are only asked whether they are met.
_L, _R = r"(^|[^A-Za-z0-9_])", r"($|[^A-Za-z0-9_])"
#: What a span can hold that matters, in order of precedence: the name of a class, and what shows it.
CRITICAL = (
    # a sign or code of a currency before digits, or digits in groups, or with two decimals
    ("CURRENCY_AMOUNT", r"[₹€£$] ?[0-9]|" + _L + r"(Rs|INR|USD|EUR|GBP)[.]? ?[0-9]|" + _L + r"[0-9]{1,3}(,[0-9]{2,3})+([.][0-9]+)?" + _R + "|" + _L + r"[0-9]+[.][0-9]{2}" + _R),
    # the shapes of tax, goods tax, bank routing and court case numbers
    ("STATUTORY_IDENTIFIER", _L + r"([A-Z]{5}[0-9]{4}[A-Z]|[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]|[A-Z]{4}0[A-Z0-9]{6}|[A-Z]{4}[0-9]{12})" + _R),
    # a word for an account, payment or reference, and a code with a digit after it
    ("ACCOUNT_REFERENCE", r"(?i)" + _L + r"(account|acc?t|a/c|savings|loan|cheque|chq|utr|upi|imps|neft|rtgs|txn|transaction|payment|ref|reference|खाता|संदर्भ)( ?(no|number|id|संख्या))?[ .:#-]*[a-z]*[0-9][a-z0-9/-]*"),
    # a part of a statute and its number
    ("LEGAL_REFERENCE", r"(?i)" + _L + r"(sections?|sec|rules?|articles?|orders?|clauses?|धारा|नियम|अनुच्छेद)[. ]*(no[.]? ?)?([0-9]+|[ivxlc]+)" + _R),
    # digits or a month's name in the order of a date
    ("DATE", _L + r"([0-9]{1,2}[-/.][0-9]{1,2}[-/.]([0-9]{4}|[0-9]{2})|[0-9]{4}-[0-9]{2}-[0-9]{2}|(?i:[0-9]{1,2}[ -](jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ ,-]+[0-9]{2,4}))" + _R),
    ("PERCENTAGE_RATE", r"(?i)[0-9]([.][0-9]+)? ?(%|per ?cent|p[.]a[.]|per annum|प्रतिशत)"),
    # a short label whose value stands in the next span
    ("LABEL_PREFIX", r"^[^0-9:]{2,40}:$"),
)
#: A span that only names what the next one holds.
LABEL = (
    r"(?i)^((customer|account|a/c|acct|policy|loan|card|cheque|invoice|bill|order|case|reference|ref|utr|txn|transaction|pan|tan|gstin|gst|cin|cnr|din|ifsc|aadhaar|phone|mobile)[ .]*(no|number|id|code)?"
    r"|(opening|closing|total|net|value|due|issue|birth)? ?(balance|amount|date)|नाम|पता|दिनांक|खाता संख्या|राशि|शेष|संदर्भ संख्या)[ .:#-]*$"
)
#: Facts that a copy or a translation of a text has to keep, by precedence.
FACTS = (
    ("url", r"https?://[^ \n\t]+|www\.[^ \n\t]+"),
    ("email", r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[a-zA-Z]{2,}"),
    ("statutory", r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]|[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}|[A-Z]{5}[0-9]{4}[A-Z]|[A-Z]{4}0[A-Z0-9]{6}"),
    ("date", r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("id", r"[A-Za-z]+[0-9][A-Za-z0-9_-]*"),
    ("percent", r"-?[0-9]+(,[0-9]+)*(\.[0-9]+)? *%"),
    # a currency and its amount are two facts
    ("money", r"(₹|€|£|Rs\.?|INR|USD|EUR) *-?[0-9]+(,[0-9]+)*(\.[0-9]+)?"),
    ("number", r"-?[0-9]+(,[0-9]+)*(\.[0-9]+)?"),
)


def any_script(pattern: str) -> str:
    """``pattern`` with ``\\b``, ``\\s`` and ``\\d`` (outside of brackets) as Python has them: words, blanks and digits of every
    script, where signs that join a letter belong to no word. A ``\\b`` at the start stands before, others after a character of a word."""
    word = r"[\p{L}\p{N}_]"
    x = re.sub(r"^\\b", lambda _: f"(?<!{word})", pattern)
    return x.replace(r"\b", f"(?!{word})").replace(r"\s", r"[\t-\r\x1c-\x20\x85\p{Z}]").replace(r"\d", r"\p{Nd}")


def ascii_numerals(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, "0123456789")


def normalise_spacing(c: Column) -> Column:
    """Runs of blanks become one, none stand before punctuation or at line ends, at most one empty line in a row."""
    x = F.regexp_replace(c, r"[ \t\x{00A0}]+", " ")
    x = F.regexp_replace(x, r" +([,.;:!?।])", "$1")
    x = F.regexp_replace(x, r" *\n *", "\n")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def header_template(c: Column) -> Column:
    """A line in small letters with digits as ``#`` and single blanks: what running headers share."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]", "#"), r"[ \t]+", " "))


def critical_class(c: Column) -> Column:
    out = F.lit(None).cast("string")
    x = F.trim(c)
    for name, pattern in reversed(CRITICAL):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return F.when(F.length(x) >= 2, out)


def script_language(c: Column) -> Column:
    """The language that script and marker words show: Latin is English; Devanagari by its markers, else Hindi."""
    deva, latin = F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    words = F.split(c, r"[ \n\t.,।?!]+")
    n = lambda xs: F.size(F.array_intersect(words, F.array(*[F.lit(x) for x in xs])))
    kind = F.when((n(MARATHI) > 0) & (n(MARATHI) > n(HINDI)), "mr").when((n(NEPALI) > 0) & (n(NEPALI) > n(HINDI)), "ne").otherwise("hi")
    return F.when(F.trim(c) == "", "unknown").when((deva > latin) & (deva > 0), kind).when(latin > 0, "en").otherwise("unknown")


def latin_only(c: Column) -> Column:
    """``c`` without characters of other scripts; empty if no letter or digit is left."""
    x = F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\x20-\x7E]+", " "), " +", " "))
    return F.when(x.rlike("[A-Za-z0-9]"), x).otherwise("")


def usable(text: Column, coverage: Column | None = None) -> Column:
    """Whether a page's text can be used: not blank, below 5 % replacement or control characters, and not a scan with
    hardly any text."""
    x = F.trim(text)
    n = F.length(x)
    broken = F.regexp_count(x, F.lit(r"\x{FFFD}")) / n
    control = F.regexp_count(x, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")) / n
    ok = (n > 0) & (broken < 0.05) & (control < 0.05)
    if coverage is not None:
        ok = ok & ~((coverage >= 0.75) & (n < 30))
    return F.coalesce(ok, F.lit(False))


def facts(c: Column) -> Column:
    """The facts of ``c``: each kind is taken and blanked out before the next, numbers without grouping commas."""
    rest, parts = ascii_numerals(c), []
    for kind, pattern in FACTS:
        found = F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1))
        plain = F.transform(found, lambda t: F.lower(F.regexp_replace(t, ",| ", "")))
        if kind == "money":
            amounts = F.transform(plain, lambda t: F.regexp_replace(t, r"^[^0-9-]+", ""))
            signs = F.transform(plain, lambda t: F.regexp_replace(F.regexp_replace(t, r"[0-9.-]+$", ""), r"^(₹|rs)$", "inr"))
            plain = F.concat(signs, amounts)
        parts.append(plain)
        rest = F.regexp_replace(rest, pattern, " ")
    return F.concat(*parts)


def sanitise_message(c: Column) -> Column:
    """A message without quoted, UNC, Windows and absolute paths."""
    x = F.regexp_replace(c, r"['\"][^'\"]*[/\\][^'\"]*['\"]", "<path>")
    x = F.regexp_replace(x, r"\\\\[^ ]+", "<path>")
    x = F.regexp_replace(x, r"\b[A-Za-z]:\\[^ ]+", "<path>")
    return F.regexp_replace(x, r"(^| )/[^ ]+/[^ ]+", "$1<path>")


def xml_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Texts in the composed normal form."""
    return c.str.normalize("NFC")


def character_error_rate(source: Column, target: Column) -> Column:
    """Edits per character of ``source``, both composed; without a character 0 or 1."""
    x, y = [F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(nfc(c)) for c in (source, target)]
    return F.when(F.length(x) == 0, F.when(F.length(y) == 0, 0.0).when(y.isNotNull(), 1.0)).otherwise(F.try_divide(F.levenshtein(x, y), F.length(x)))


def citations(c: Column) -> Column:
    """Distinct references to sections, rules and articles, all of them, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:Section|Rule|Article|Order) [0-9]+[A-Z]?)"), F.lit(1)))


def restore(text: Column, spans: Column) -> Column:
    """``text`` with each span's placeholder replaced by its value."""
    return F.aggregate(spans, text, lambda acc, s: F.replace(acc, s["placeholder"], s["value"]))
