"""Bank and statutory identifiers: validity, check digits, repair of misread characters, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the public registers.
STATES = tuple("AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PN PY RJ SK TG TN TR TS UK UP UR UT WB AN".split())
OWNERSHIPS = tuple("PTC PLC GOI NPL ULL SGC FTC FLC GAP GAT OPC LLP".split())
PAN_KINDS = "ABCFGHJLPT"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that scanners take for each other.
TO_LETTER = ("01582", "OISBZ")
TO_DIGIT = ("ODQISBZ", "0001582")
#: The same for tax numbers, where L is read as 1, and D and Q stay letters.
TAX_DIGIT = ("OILSBZ", "011582")


def _clean(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s\-_:/]", ""))


def _upper(c: Column) -> Column:
    """Separators inside a tax number make it none, so only the blanks around it go."""
    return F.upper(F.trim(c))


def verify_pan(c: Column) -> Column:
    return _upper(c).rlike(rf"^[A-Z]{{3}}[{PAN_KINDS}][A-Z][0-9]{{4}}[A-Z]$")


def verify_tan(c: Column) -> Column:
    return _upper(c).rlike(r"^[A-Z]{4}[0-9]{5}[A-Z]$")


def verify_cin(c: Column) -> Column:
    x = _clean(c)
    year = F.substring(x, 9, 4).try_cast("int")
    return x.rlike(r"^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$") & F.substring(x, 7, 2).isin(*STATES) & year.between(1850, 2035) & F.substring(x, 13, 3).isin(*OWNERSHIPS)


def verify_cnr(c: Column) -> Column:
    return _clean(c).rlike(r"^[A-Z]{4}[0-9]{12}$")


def verify_din(c: Column) -> Column:
    return F.trim(c).rlike(r"^[0-9]{8}$")


def gstin_check_digit(c: Column) -> Column:
    """The check digit of the first 14 characters: base 36, weights 1 and 2 in turn, digits of each product added."""
    x = F.upper(c)

    def step(total: Column, i: Column) -> Column:
        product = (F.instr(F.lit(BASE36), F.substr(x, i, F.lit(1))) - 1) * F.when(i % 2 == 1, 1).otherwise(2)
        return total + F.floor(product / 36) + product % 36

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0).cast("long"), step)
    return F.substr(F.lit(BASE36), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))


def verify_gstin(c: Column) -> Column:
    x = _upper(c)
    state = F.substring(x, 1, 2).try_cast("int")
    return (
        x.rlike(r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$") & (state.between(1, 38) | state.isin(97, 99)) & verify_pan(F.substring(x, 3, 10))
        & (F.substring(x, 15, 1) == gstin_check_digit(F.substring(x, 1, 14)))
    )


def verify_ifsc(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike(r"^[A-Z]{4}0[A-Z0-9]{6}$")


def repair_ifsc(c: Column) -> Column:
    """The code with misread characters put right by position, or as it was (without separators) if that gives no valid one."""
    x = F.upper(F.regexp_replace(c, r"[\s\-_]", ""))
    fifth = F.substring(x, 5, 1)
    fixed = F.concat(F.translate(F.substring(x, 1, 4), *TO_LETTER), F.when(fifth.rlike("[1-9]"), fifth).otherwise("0"), F.substring(x, 6, 6))
    fifth_ok = F.when((F.length(x) == 11) & verify_ifsc(fixed), fixed)
    return F.coalesce(fifth_ok, x)


def repair_utr(c: Column) -> Column:
    """(value, kind) of a transfer reference: 12 digits UPI or IMPS, 16 characters NEFT, 22 characters RTGS."""
    x = _clean(c)
    digits = lambda y: F.translate(y, *TO_DIGIT)
    letters = lambda y: F.translate(y, *TO_LETTER)
    upi = digits(x)
    neft = F.concat(letters(F.substring(x, 1, 4)), digits(F.substring(x, 5, 12)))
    rtgs = F.concat(letters(F.substring(x, 1, 4)), F.substring(x, 5, 1), digits(F.substring(x, 6, 17)))
    kind = (
        F.when((F.length(x) == 12) & ~x.rlike("^[A-Z]{4}") & upi.rlike("^[0-9]{12}$"), "UPI")
        .when((F.length(x) == 16) & neft.rlike("^[A-Z]{4}[0-9]{12}$"), "NEFT")
        .when((F.length(x) == 22) & rtgs.rlike("^[A-Z]{4}[R0-9][0-9]{17}$"), "RTGS")
    )
    value = F.when(kind == "UPI", upi).when(kind == "NEFT", neft).when(kind == "RTGS", rtgs).otherwise(x)
    return F.struct(value.alias("value"), kind.alias("kind"))


def repair_pan(c: Column) -> Column:
    x = _clean(c)
    fixed = F.concat(F.translate(F.substring(x, 1, 5), *TO_LETTER), F.translate(F.substring(x, 6, 4), *TAX_DIGIT), F.translate(F.substring(x, 10, 1), *TO_LETTER))
    return F.when((F.length(x) == 10) & verify_pan(fixed), fixed).otherwise(x)


def mask_account(c: Column) -> Column:
    """All but the last four characters hidden."""
    x = F.regexp_replace(c, r"[\s-]", "")
    return F.when(F.length(x) > 4, F.concat(F.repeat(F.lit("X"), F.length(x) - 4), F.right(x, F.lit(4)))).otherwise(x)


def fingerprint(*parts: Column, size: int = 16) -> Column:
    """A short digest of the parts, in small letters and trimmed."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.lower(F.trim(p)) for p in parts]), 256), 1, size)


def header_normalise(c: Column) -> Column:
    """A column label in small letters without punctuation and currency words."""
    x = F.regexp_replace(F.lower(c), r"[^a-z0-9 ऀ-ॿ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(^| )(inr|rs)( |$)", " "), r" +", " "))


def input_location(stem: Column, page: Column, row: Column, sheet: bool = False) -> Column:
    return F.concat(stem, F.lit("_S" if sheet else "_P"), page.cast("string"), F.lit("_R"), F.lpad(row.cast("string"), 2, "0"))
