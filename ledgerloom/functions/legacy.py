"""Text in legacy Devanagari fonts: told apart, converted, reversed, and the structure of the result checked.

A profile maps glyph codes to Unicode. Conversion goes by ordered passes: longest match, vowel signs that are typed before
their consonant moved behind it, the repha moved in front of its syllable, composition.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONSONANT = "[\u0915-\u0939\u0958-\u095f]\u093c?"


@dataclass(frozen=True)
class Profile:
    """A font family: glyph codes, codes of the short i and the repha, and words that show it."""

    name: str
    glyphs: dict[str, str]
    short_i: str
    repha: str
    signatures: tuple[str, ...]
    aliases: tuple[str, ...] = field(default=())


#: Fixed values of a widespread typewriter layout; other layouts are passed in.
TYPEWRITER = Profile(
    "typewriter",
    {
        "vks": "ओ", "vkS": "औ", "vk": "आ", "v": "अ", "bZ": "ई", "b": "इ", "m": "उ", "Å": "ऊ", ",s": "ऐ", ",": "ए",
        "d": "क", "[k": "ख", "x": "ग", "?k": "घ", "p": "च", "N": "छ", "t": "ज", ">": "झ", "V": "ट", "B": "ठ", "M": "ड", "<": "ढ", ".k": "ण",
        "r": "त", "Fk": "थ", "n": "द", "/k": "ध", "u": "न", "i": "प", "Q": "फ", "c": "ब", "Hk": "भ", "e": "म", ";": "य", "j": "र", "y": "ल", "o": "व",
        "'k": "श", '"k': "ष", "l": "स", "g": "ह", "{k": "क्ष", "K": "ज्ञ", "ks": "ो", "kS": "ौ", "k": "ा", "h": "ी", "q": "ु", "w": "ू", "s": "े", "S": "ै",
        "a": "ं", "¡": "ँ", "%": "ः", "~": "्", "z": "्र", "D": "क्", "R": "त्", "U": "न्", "I": "प्", "E": "म्", "Y": "ल्", "O": "व्", "L": "स्", "A": "।",
    },
    "f",
    "Z",
    ("esa", "gS", "dh", "ds", "dks", "vkSj", "ugha", "ij"),
    ("kruti dev", "krutidev", "devlys"),
)


def convert(text: str, profile: Profile = TYPEWRITER) -> str:
    """``text`` in Unicode."""
    keys = sorted(profile.glyphs, key=len, reverse=True)
    pattern = re.compile("|".join(re.escape(k) for k in [*keys, profile.short_i, profile.repha]))
    # the short i and the repha keep places of their own until the rest is mapped
    x = pattern.sub(lambda m: {profile.short_i: "\ue000", profile.repha: "\ue001"}.get(m[0]) or profile.glyphs[m[0]], text)
    x = prebase_reorder(x, "\ue000")
    x = repha_reorder(x, "\ue001")
    return unicodedata.normalize("NFC", heal(x))


def prebase_reorder(x: str, mark: str = "\ue000") -> str:
    """A vowel sign typed before its consonants, behind them."""
    return re.sub(f"{mark}((?:{CONSONANT}्)*{CONSONANT})", r"\1ि", x)


def prebase_column(c: Column, mark: str = "\ue000") -> Column:
    """The same for a column, as one pattern."""
    return F.regexp_replace(c, f"{mark}((?:{CONSONANT}्)*{CONSONANT})", "$1ि")


def repha_column(c: Column, mark: str = "\ue001") -> Column:
    return F.regexp_replace(c, f"((?:{CONSONANT}्)*{CONSONANT}[ा-ौंँः]*){mark}", "र्$1")


def repha_reorder(x: str, mark: str = "\ue001") -> str:
    """A repha typed after its syllable, in front of it."""
    return re.sub(f"((?:{CONSONANT}्)*{CONSONANT}[ा-ौंँः]*){mark}", r"र्\1", x)


def heal(x: str) -> str:
    """Signs that came doubled or in the wrong order put right."""
    x = re.sub("ाे", "ो", x)
    x = re.sub("ाै", "ौ", x)
    x = re.sub("अा", "आ", x)
    x = re.sub("([ंँः])([ा-ौ])", r"\2\1", x)
    return re.sub("्([ा-ौ])", r"\1", re.sub("([ा-ौ])\\1+", r"\1", x))


def reverse(text: str, profile: Profile = TYPEWRITER) -> str:
    """Unicode text in glyph codes of ``profile``."""
    x = re.sub(f"र्((?:{CONSONANT}्)*{CONSONANT}[ा-ौंँः]*)", "\\1\ue001", text)
    x = re.sub(f"((?:{CONSONANT}्)*{CONSONANT})ि", "\ue000\\1", x)
    back: dict[str, str] = {}
    for code, value in sorted(profile.glyphs.items(), key=lambda kv: len(kv[0])):
        back.setdefault(value, code)
    back |= {"\ue000": profile.short_i, "\ue001": profile.repha}
    keys = sorted(back, key=len, reverse=True)
    return re.sub("|".join(map(re.escape, keys)), lambda m: back[m[0]], x)


def mac_repair(text: str) -> str:
    """Text of the old Latin code page that was read as the other platform's, where that is strictly reversible."""
    try:
        return text.encode("mac-roman").decode("cp1252")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return text


def by_text(f, c: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run(c)


def converted(c: Column, profile: Profile = TYPEWRITER) -> Column:
    return by_text(lambda t: convert(t, profile), c)


def reversed_column(c: Column, profile: Profile = TYPEWRITER) -> Column:
    return by_text(lambda t: reverse(t, profile), c)


def composed(c: Column) -> Column:
    """Canonical composition, for which there is no built-in expression."""
    return by_text(lambda t: unicodedata.normalize("NFC", heal(t)), c)


def signature_score(c: Column, profile: Profile = TYPEWRITER) -> Column:
    """Twice the signature words found, less three times the Devanagari letters' presence."""
    words = F.split(c, r"\s+")
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(s) for s in profile.signatures])))
    return 2 * hits - F.when(c.rlike(r"[\x{0900}-\x{097F}]"), 3).otherwise(0)


def legacy_text(c: Column, profile: Profile = TYPEWRITER) -> Column:
    return signature_score(c, profile) >= 4


def structure_defects(c: Column) -> Column:
    """Codes of what can't be in well-formed Devanagari."""
    checks = (("LEADING_SIGN", r"(^|\s)[\x{093E}-\x{094D}]"), ("DOUBLE_VIRAMA", r"\x{094D}\x{094D}"), ("DOUBLE_SIGN", r"[\x{093E}-\x{094C}][\x{093E}-\x{094C}]"), ("SIGN_AFTER_VIRAMA", r"\x{094D}[\x{093E}-\x{094C}]"))
    return F.array_compact(F.array(*[F.when(c.rlike(p), n) for n, p in checks]))


def coverage(c: Column, profile: Profile = TYPEWRITER) -> Column:
    """Share of the characters other than blanks that the profile maps."""
    known = "".join(sorted({ch for k in profile.glyphs for ch in k} | {profile.short_i, profile.repha}))
    n = F.length(F.regexp_replace(c, r"\s", ""))
    return F.when(n > 0, F.length(F.regexp_replace(c, f"[^{re.escape(known)}]", "")) / n)


def font_family(name: Column, profiles: tuple[Profile, ...] = (TYPEWRITER,)) -> Column:
    x = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for p in profiles:
        for a in p.aliases:
            out = F.when(x.contains(a), p.name).otherwise(out)
    return F.when(x.rlike("unicode|mangal|nirmala|noto|times|arial|calibri"), "preserve").otherwise(out)


def residual(c: Column) -> Column:
    """Glyph codes that a conversion left among Devanagari letters."""
    return F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}][A-Za-z\[{>]|[A-Za-z\[{>][\x{0900}-\x{097F}]"))


def profile_rank(c: Column, profiles: tuple[Profile, ...] = (TYPEWRITER,)) -> Column:
    """(score, profile) pairs, best first: signatures twice, coverage five times."""
    ranked = F.array(*[F.struct((signature_score(c, p) + 5 * F.coalesce(coverage(c, p), F.lit(0.0))).alias("score"), F.lit(p.name).alias("profile")) for p in profiles])
    return F.reverse(F.array_sort(ranked))


def run_profile(name: Column, text: Column, profile: Profile = TYPEWRITER) -> Column:
    """What to do with a run: preserve it, or convert it by a profile that its font or, failing that, its text shows."""
    family = font_family(name, (profile,))
    deva = text.rlike(r"[\x{0900}-\x{097F}]")
    return F.when(deva | (family == "preserve"), "preserve").when(family.isNotNull(), family).when(legacy_text(text, profile), profile.name).otherwise("preserve")
