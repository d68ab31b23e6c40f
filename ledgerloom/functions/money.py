"""Amounts, balances, modes and display forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing amount.
NULL_WORDS = ("", "-", "--", "na", "n/a", "nil", "null")
#: Modes by what a narration holds, first hit wins.
MODES = (("UPI", "upi"), ("NEFT", "neft"), ("RTGS", "rtgs"), ("IMPS", "imps"), ("CASH", "cash|atm"), ("CHEQUE", "chq|cheque|clg"), ("CHARGES", "chg|charge|fee"), ("INTEREST", "interest|int cr"), ("TRANSFER", "transfer|trf"))


def placeholder_clean(c: Column, words: tuple[str, ...] = NULL_WORDS) -> Column:
    """``c`` trimmed, null where it only stands for a missing value."""
    x = F.trim(c)
    return F.when(~F.lower(x).isin(*words), x)


def parse_decimal(c: Column, scale: int = 2) -> Column:
    """An exact amount: brackets or a minus at either end make it negative; currency marks, Dr/Cr, grouping commas and
    grouping spaces go; anything else is null."""
    x = placeholder_clean(c)
    bracketed = x.rlike(r"^\(.*\)$")
    bare = F.trim(F.regexp_replace(x, r"^\(|\)$", ""))
    core = F.regexp_replace(bare, r"^-", "")
    core = F.regexp_replace(core, r"(?i)^\s*(rs\.?|inr|₹|\$|€|£)\s*", "")
    core = F.trim(F.regexp_replace(core, r"(?i)\s*(dr\.?|cr\.?|od|/-)\s*$", ""))
    minus = bracketed | bare.startswith("-") | core.endswith("-")
    core = F.regexp_replace(core, "-$", "")
    core = F.regexp_replace(F.trim(core), ",", "")
    core = F.when(core.rlike(r"^\d{1,3}( \d{3})+(\.\d+)?$"), F.regexp_replace(core, " ", "")).otherwise(core)
    value = F.when(core.rlike(r"^\d+(\.\d+)?$|^\.\d+$"), core.try_cast(f"decimal(38,{scale})"))
    return F.when(minus, -value).otherwise(value)


def parse_balance(c: Column) -> Column:
    """A balance: Dr or OD makes it negative, Cr positive."""
    value = parse_decimal(c)
    x = F.lower(F.trim(c))
    debit, credit = x.rlike(r"(^|[^a-z])(dr|od)\.?$"), x.rlike(r"(^|[^a-z])cr\.?$")
    return F.when(debit, -F.abs(value)).when(credit, F.abs(value)).otherwise(value)


def transaction_mode(c: Column) -> Column:
    x = F.lower(c)
    out = F.lit(None).cast("string")
    for mode, pattern in reversed(MODES):
        out = F.when(x.rlike(pattern), mode).otherwise(out)
    return out


def indian_format(c: Column) -> Column:
    """An amount with digits grouped in lakhs and crores."""
    text = F.abs(c).cast("decimal(38,2)").cast("string")
    whole, cents = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)+\d$)", ",")
    return F.concat(F.when(c < 0, "-").otherwise(""), grouped, F.lit("."), cents)


def debit_credit(debit: Column, credit: Column, amount: Column, direction: Column) -> Column:
    """(debit, credit) from two columns, or from one amount with a direction or a sign; never guessed."""
    word = F.lower(F.trim(direction))
    out = word.isin("dr", "d", "debit", "w", "withdrawal", "-1")
    into = word.isin("cr", "c", "credit", "deposit", "1")
    two = debit.isNotNull() | credit.isNotNull()
    return F.struct(
        F.when(two, debit).when(out, F.abs(amount)).when(word.isNull() & (amount < 0), -amount).alias("debit"),
        F.when(two, credit).when(into, F.abs(amount)).when(word.isNull() & (amount > 0), amount).alias("credit"),
    )
