"""Parts of SQL that several queries share: days, times and words in cells."""

from __future__ import annotations

from ledgerloom.functions import dates

_LONG, _SHORT = (", ".join(f"'{f}'" for f in dates.DATES if y in f) for y in ("%Y", "%y"))
_HEAD = r"regexp_extract({x}, '^[^ \t\r\f]+')"


def _tried(*cells: str) -> str:
    """Years of four digits and of two apart, as SQL takes either for the other."""
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({c}, '[0-9]{{4}}') THEN try_strptime({c}, [{_LONG}]) ELSE try_strptime({c}, [{_SHORT}]) END" for c in cells) + ")"


def day(c: str) -> str:
    """The day in cell ``c`` as YYYY-MM-DD: ISO first, then day before month in all formats, also of what stands before a time."""
    x = rf"trim(trim(replace(replace(trim({c}), chr(10), ''), chr(160), ' ')), chr(39) || chr(34))"
    head = _HEAD.format(x=x)
    return (
        rf"CAST(CAST(coalesce(CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN TRY_CAST(left({x}, 10) AS TIMESTAMP) WHEN regexp_matches({x}, '^[0-9]{{8}}$') THEN try_strptime({x}, '%Y%m%d') END, "
        + _tried(x, f"translate({x}, '.-', '//')") + f", CASE WHEN contains({x}, ':') THEN " + _tried(head, f"translate({head}, '.-', '//')") + " END) AS DATE) AS VARCHAR)"
    )


def time(c: str) -> str:
    """The time of day in cell ``c`` as HH:MM:SS, of 24 or 12 hours."""
    x = f"trim({c})"
    m = rf"regexp_extract({x}, '^((0?[1-9]|1[0-2]):[0-5][0-9](:[0-5][0-9])?)(\.[0-9]+)? ?([AaPp][Mm])([^A-Za-z]|$)', ['a', 'b', 'c', 'd', 'e', 'f'])"
    return (
        rf"coalesce(strftime(try_strptime({x}, ['%H:%M:%S', '%I:%M:%S %p', '%H:%M', '%I:%M %p']), '%H:%M:%S'), strftime(try_strptime(regexp_extract({x}, '[^ \t]+$'), ['%H:%M:%S', '%H:%M']), '%H:%M:%S'), "
        rf"CASE WHEN ({m}).e <> '' THEN strftime(try_strptime(({m}).a || ' ' || ({m}).e, ['%I:%M:%S %p', '%I:%M %p']), '%H:%M:%S') END, CASE WHEN regexp_matches({x}, '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') THEN left({x}, 8) END)"
    )


def words(c: str) -> str:
    """The words of ``c`` in small letters, sorted."""
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')), ' ')"


def distance(a: str, b: str) -> str:
    """Edits between ``a`` and ``b`` in characters: the distance counts bytes in SQL, so each character becomes one byte, by its
    place among all characters of both."""
    one = lambda x: f"list_aggregate(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: chr(CAST(31 + list_position(list_distinct(regexp_extract_all({a} || {b}, '(?s).')), c) AS INTEGER))), 'string_agg', '')"
    return f"levenshtein({one(a)}, {one(b)})"
