"""Mixed date and time notations, precisions and zones brought to one unambiguous form.

Cells are parsed to a local wall-clock time with built-in expressions. Local times are joined to zone-offset intervals
(each interval of a zone exploded to the local years it touches, so that the join is an equi-join on zone and year): two
matching intervals mean that the time occurs twice, none that it never occurs, one gives the offset. Every year has its
intervals: before the first year of the table each zone has one offset only, and after the last change of rules the calendar
repeats itself every 400 years, so later years are looked up in the first 400 of them.

Defined results: null, blank and placeholder cells, impossible days and impossible times give no value. A wall-clock time
without any known zone, or one that its zone has twice or never, gives none either. Two-digit years are 20xx, missing
seconds 0. An empty table gives no rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

#: Years that intervals are listed for. No zone of the database changes its offset before the first; after the last year
#: less 400 all rules are yearly ones, and a span of 400 years is a whole number of weeks.
FIRST_YEAR, LAST_YEAR = 1800, 2499
CYCLE_YEARS, CYCLE_SECONDS = 400, 146_097 * 86_400
#: Month names, English and Hindi, by their first three letters or in full.
MONTHS: dict[str, int] = {
    m: i
    for i, names in enumerate(
        [
            ("jan", "january", "जनवरी"), ("feb", "february", "फरवरी", "फ़रवरी"), ("mar", "march", "मार्च"), ("apr", "april", "अप्रैल"),
            ("may", "मई"), ("jun", "june", "जून"), ("jul", "july", "जुलाई"), ("aug", "august", "अगस्त"), ("sep", "sept", "september", "सितंबर", "सितम्बर"),
            ("oct", "october", "अक्टूबर", "अक्तूबर"), ("nov", "november", "नवंबर", "नवम्बर"), ("dec", "december", "दिसंबर", "दिसम्बर"),
        ],
        1,
    )
    for m in names
}
#: Abbreviations that mean the same everywhere, in seconds east of UTC.
UNIVERSAL = {"Z": 0, "UTC": 0, "GMT": 0}
#: Abbreviations in use that the zone database has as plain offsets only.
LOCAL_NAMES = {("Asia/Dubai", "GST"): 4 * 3600, ("Asia/Singapore", "SGT"): 8 * 3600}
_DIGITS = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯௦௧௨௩௪௫௬௭௮௯٠١٢٣٤٥٦٧٨٩０１２３４５６７８９"
_ZONE = r"(?:\s*(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?\s*[+-]\d{1,2}:?\d{2}))?"
_TIME = (
    r"(?:(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,6}))?)?|(\d{2})(\d{2})(\d{2})|(\d{1,2})h(\d{2}))"
    r"(?:\s*([AaPp])\.?[Mm]\.?)?"
)


def ascii_digits(c: Column) -> Column:
    """``c`` trimmed, with digits of other scripts as ASCII digits."""
    return F.translate(F.trim(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), _DIGITS, "0123456789" * 5)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _number_or_month(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.coalesce(_int(c), F.try_element_at(table, F.lower(c)))


_WORD = r"[\p{L}\p{M}]{2,}"
_PARTS = rf"^(\d{{1,4}}|{_WORD})[-/.\s]\s*(\d{{1,2}}|{_WORD})[-/.,\s]+(\d{{4}}|\d{{1,2}})(?:(?:T|\s+)(.+))?$"
_SOLID = r"^(\d{5}(?:\.\d+)?|\d{8}|\d{10}|\d{13}|\d{16})$"


def _groups(x: Column, pattern: str, n: int) -> Column:
    """The ``n`` groups of ``pattern`` in ``x`` as an array, by one match; null where it doesn't match."""
    marked = F.regexp_replace(x, pattern, "\u0001".join(f"${i}" for i in range(1, n + 1)))
    return F.when(marked.contains("\u0001"), F.split(marked, "\u0001"))


def split_cell(c: Column, name: str) -> list[Column]:
    """The parts of a date cell: three tokens and the rest after them, and what is written as one number."""
    x = ascii_digits(c)
    return [_groups(x, _PARTS, 4).alias(name), F.when(x.rlike(_SOLID), x).otherwise("").alias(f"{name}_solid")]


def tokens(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the split cell ``name`` as three tokens, a run of eight digits included, and ``{name}_form``: the order
    of day, month and year where the tokens themselves show it."""
    parts, solid = F.col(name), F.col(f"{name}_solid")
    cut = lambda *at: F.array(*[F.substring(solid, i, n) for i, n in at], F.lit(""))
    run = F.when(F.length(solid) == 8, F.when(solid.substr(1, 4).between("1900", "2099"), cut((1, 4), (5, 2), (7, 2))).otherwise(cut((1, 2), (3, 2), (5, 4))))
    df = df.withColumn(name, F.coalesce(parts, run))
    p = F.col(name)
    shown = F.when(p[0].rlike("^\\D"), "MDY").when(p[1].rlike("^\\D"), "DMY").when(F.length(p[0]) == 4, "YMD")
    return df.withColumn(f"{name}_form", shown)


def day_of(df: DataFrame, name: str, order: Column, out: str) -> DataFrame:
    """``df`` with the calendar day ``out`` of the split cell ``name``, where ``order`` is DMY, MDY or YMD; null where it
    is none."""
    p, solid = F.col(name), F.col(f"{name}_solid")
    usable = F.when((order != "YMD") | (F.length(p[2]) == 2), order)
    df = df.withColumn("_form", F.coalesce(f"{name}_form", usable))
    form = F.col("_form")
    df = df.withColumn(
        "_ymd",
        F.when(form == "YMD", F.array(p[0], p[1], p[2])).when(form == "MDY", F.array(p[2], p[0], p[1])).when(form == "DMY", F.array(p[2], p[1], p[0])),
    )
    y, m, d = (F.col("_ymd")[i] for i in range(3))
    text = F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(_number_or_month(m).cast("string"), 2, "0"), F.lpad(d, 2, "0"))
    serial = F.date_add(F.lit(dt.date(1899, 12, 30)), _int(F.substring(solid, 1, 5)))
    epoch = _epoch_day(epoch_micros(solid))
    return df.withColumn(
        out, F.when(solid.rlike(r"^\d{5}(\.|$)"), serial).when(F.length(solid) >= 10, epoch).otherwise(F.try_to_date(text, "yyyy-MM-dd"))
    ).drop("_form", "_ymd")


def _epoch_day(micros: Column) -> Column:
    return F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(micros / 86_400_000_000).cast("int"))


def epoch_micros(a: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970, by the number of digits, as microseconds."""
    n = a.try_cast("long")
    return F.when(F.length(a) == 10, n * 1_000_000).when(F.length(a) == 13, n * 1000).when(F.length(a) == 16, n)


def clock(df: DataFrame, c: Column) -> DataFrame:
    """``df`` with the time-of-day cell ``c`` as ``us``, microseconds of the day (null where it is impossible), and ``wz``,
    the zone written in it."""
    df = df.withColumn("_g", _groups(ascii_digits(c), f"^{_TIME}{_ZONE}$", 11))
    g = [F.col("_g")[max(i - 1, 0)] for i in range(12)]
    pick = lambda *i: _int(F.concat(*[g[k] for k in i]))
    df = df.withColumn("_h", pick(1, 5, 8)).withColumn("_m", pick(2, 6, 9)).withColumn("_s", F.coalesce(pick(3, 7), F.lit(0)))
    h, m, s, half = F.col("_h"), F.col("_m"), F.col("_s"), F.lower(g[10])
    hour = F.when(half == "", F.when(h < 24, h)).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    us = F.when((m < 60) & (s < 60), ((hour * 60 + m) * 60 + s).cast("long") * 1_000_000 + _int(F.rpad(g[4], 6, "0")))
    return df.withColumn("us", us).withColumn("wz", F.nullif(g[11], F.lit(""))).drop("_g", "_h", "_m", "_s")


def offset_of(zone: Column) -> Column:
    """Seconds east of UTC of a zone written as an offset; null for names."""
    pattern = r"^(?:UTC|GMT)?\s*([+-])(\d{1,2}):?(\d{2})$"
    secs = _int(F.regexp_extract(zone, pattern, 2)) * 3600 + _int(F.regexp_extract(zone, pattern, 3)) * 60
    return F.when(zone.rlike(pattern), F.when(F.regexp_extract(zone, pattern, 1) == "-", -secs).otherwise(secs))


def _intervals(name: str, first: int, last: int) -> list[tuple[int, int, int, str]]:
    """(local start, local end, offset, abbreviation), in seconds since 1970 of local time, over the given years."""
    try:
        zone = ZoneInfo(name)
    except Exception:
        return []
    utc = dt.timezone.utc
    at = lambda t: (t.astimezone(zone).utcoffset(), t.astimezone(zone).tzname())
    epoch = lambda t: int(t.timestamp())
    t, end = dt.datetime(first, 1, 1, tzinfo=utc) - dt.timedelta(days=2), dt.datetime(last, 12, 31, tzinfo=utc) + dt.timedelta(days=3)
    out = []
    begun, state = t, at(t)
    while t < end:
        after = min(t + dt.timedelta(days=7), end)
        if at(after) != state or after == end:
            low, high = t, after
            if at(after) != state:
                while (high - low) > dt.timedelta(seconds=1):
                    mid = (low + (high - low) / 2).replace(microsecond=0)
                    low, high = (mid, high) if at(mid) == state else (low, mid)
            off = int(state[0].total_seconds())
            out.append((epoch(begun) + off, epoch(high) + off, off, state[1]))
            begun, state = high, at(high)
            t = high
        else:
            t = after
    return out


def zone_intervals(zones: DataFrame, column: str) -> DataFrame:
    """(zone, year, spans): the zone-offset intervals of each zone in ``zones``, exploded to the local years they touch.

    At most as many rows as the zone database has names (about 600) times the years listed, whatever ``zones`` holds: names
    it doesn't know give none.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name in f.iloc[:, 0]:
                rows: dict[int, list] = {}
                for lo, hi, off, abbr in _intervals(name, FIRST_YEAR, LAST_YEAR):
                    span = {"lo": lo, "hi": hi, "off": off, "abbr": abbr}
                    for y in range(max(FIRST_YEAR, _local_year(lo)), min(LAST_YEAR, _local_year(hi)) + 1):
                        rows.setdefault(y, []).append(span)
                if rows:
                    yield pd.DataFrame({"zone": name, "year": list(rows), "spans": list(rows.values())})

    names = zones.select(F.col(column).alias("zone")).where("zone is not null").distinct()
    return names.mapInPandas(work, "zone string, year int, spans array<struct<lo:long,hi:long,off:int,abbr:string>>")


def listed(year: Column, local: Column) -> tuple[Column, Column]:
    """The year whose intervals hold for ``year``, and ``local`` (microseconds) moved there."""
    cycles = F.greatest(F.lit(0), F.floor((year - F.lit(LAST_YEAR - CYCLE_YEARS)) / CYCLE_YEARS)).cast("long")
    early = year < FIRST_YEAR
    middle = int(dt.datetime(FIRST_YEAR, 7, 1, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    return (
        F.when(early, FIRST_YEAR).otherwise((year - cycles * CYCLE_YEARS).cast("int")),
        F.when(early, F.lit(middle)).otherwise(local - cycles * CYCLE_SECONDS * 1_000_000),
    )


def _local_year(seconds: int) -> int:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).year


def order_evidence(cells: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, day_first, month_first): how many split cells can only be read with the day, or the month, in front."""
    first, second = (lambda n: _int(F.col(n)[0])), (lambda n: _int(F.col(n)[1]))
    add = lambda f: reduce(lambda a, b: a + b, [F.sum(F.when(f(n), 1).otherwise(0)) for n in names])
    return cells.groupBy(key).agg(
        add(lambda n: first(n).between(13, 31) & second(n).between(1, 12)).alias("day_first"),
        add(lambda n: second(n).between(13, 31) & first(n).between(1, 12)).alias("month_first"),
    )


def normalise(
    rows: DataFrame,
    statements: DataFrame,
    id: str = "row_id",
    key: str = "statement_id",
    date: str = "date",
    time: str = "time",
    value_date: str = "value_date",
    zone: str = "source_tz",
    order: str = "date_order",
) -> DataFrame:
    """(id, field, norm) with field 'date' (``date`` together with ``time``) and 'value_date'.

    norm is the instant as ``YYYY-MM-DDTHH:MM:SS.ffffffZ``, or ``YYYY-MM-DD`` where there is no time of day. Where a
    statement has no order, its own cells bear it out (day first if more cells need that than need the month first).
    """
    cells = rows.select(
        F.col(id).alias("id"),
        F.col(key).alias("key"),
        *split_cell(F.col(date), "d"),
        *split_cell(F.col(value_date), "v"),
        F.when(ascii_digits(F.col(time)).rlike(r"\d"), F.col(time)).alias("time"),
    )
    own = F.nullif(F.col("d")[3], F.lit(""))
    # everything that needs no facts of the statement comes first, and is written: cells are parsed once
    cells = written(clock(tokens(tokens(cells, "d"), "v").withColumn("timed", own.isNotNull() | F.col("time").isNotNull()), F.coalesce(own, "time")).drop("time"))
    known = statements.select(F.col(key).alias("key"), F.col(zone).alias("tz"), F.col(order).alias("given")).dropDuplicates(["key"])
    proof = order_evidence(cells, "key", ["d", "v"])
    facts = known.join(proof, "key", "full_outer").select(
        "key",
        "tz",
        F.coalesce(
            F.upper(F.trim("given")),
            F.when(F.col("day_first") > F.col("month_first"), "DMY").when(F.col("month_first") > F.col("day_first"), "MDY"),
        ).alias("order"),
    )
    solid, spreadsheet = F.col("d_solid"), F.col("d_solid").rlike(r"^\d{5}(\.|$)")
    # spreadsheet day numbers hold their time of day as a fraction, to the microsecond
    part = F.expr("cast(round(cast(concat('0', substring(d_solid, 6)) as decimal(28,18)) * 86400, 6) * 1000000 as long)")
    alone = spreadsheet & ~F.col("timed")
    ready = cells.select(
        "id", "key", "d", "v", "d_solid", "v_solid", "d_form", "v_form",
        F.when(F.length(solid) >= 10, epoch_micros(solid)).alias("epoch"),
        (alone | F.col("timed")).alias("timed"),
        F.when(alone, F.when(solid.contains("."), part).otherwise(0)).otherwise(F.col("us")).alias("us"),
        F.when(~alone, F.col("wz")).alias("wz"),
    )
    got = ready.join(facts, "key", "left")
    got = day_of(day_of(got, "d", F.col("order"), "day"), "v", F.col("order"), "vday")
    got = got.select("id", "tz", "day", "vday", "epoch", "timed", "us", "wz")
    local = F.unix_date("day").cast("long") * 86_400_000_000 + F.col("us")
    got = got.withColumn("local", F.when(F.col("timed"), local))
    year, moved = listed(F.year("day"), F.col("local"))
    got = got.withColumn("year", year).withColumn("moved", moved)

    # the bound of this table is the zone database's, so it may go to all executors, and a zone of most rows is no hot key
    spans = F.broadcast(zone_intervals(known, "tz"))
    got = got.join(spans, (got.tz == spans.zone) & (got.year == spans.year), "left").drop(spans.year)
    secs = F.floor(F.col("moved") / 1_000_000)
    here = F.filter("spans", lambda s: (s["lo"] <= secs) & (secs < s["hi"]))
    wz = F.col("wz")
    named = F.create_map(*[F.lit(x) for pair in UNIVERSAL.items() for x in pair])
    special = F.create_map(*[F.lit(x) for (z, a), off in LOCAL_NAMES.items() for x in (f"{z}|{a}", off)])
    # a zone written in the cell counts first; its abbreviation is read as the statement's own zone uses it
    of_zone = F.array_distinct(F.transform(F.filter("spans", lambda s: s["abbr"] == F.upper(wz)), lambda s: s["off"]))
    offset = F.when(
        wz.isNotNull(),
        F.coalesce(
            offset_of(wz),
            F.when(F.size(of_zone) == 1, of_zone[0]),
            F.try_element_at(special, F.concat("tz", F.lit("|"), F.upper(wz))),
            F.try_element_at(named, F.upper(wz)),
        ),
    ).when(F.size(here) == 1, here[0]["off"])
    instant = F.coalesce("epoch", F.col("local") - offset.cast("long") * 1_000_000)
    # by arithmetic, so that no zone of the session plays a part
    day_us = 86_400_000_000
    rest = F.pmod(instant, F.lit(day_us))
    clock_text = F.format_string(
        "%02d:%02d:%02d.%06d", F.floor(rest / 3_600_000_000), F.floor(rest / 60_000_000) % 60, F.floor(rest / 1_000_000) % 60, rest % 1_000_000
    )
    stamp = F.concat(_epoch_day(instant).cast("string"), F.lit("T"), clock_text, F.lit("Z"))
    date_norm = F.when(F.col("epoch").isNotNull() | F.col("timed"), F.when(F.col("day").isNotNull(), stamp)).otherwise(F.col("day").cast("string"))
    both = F.array(
        F.struct(F.lit("date").alias("field"), date_norm.alias("norm")),
        F.struct(F.lit("value_date").alias("field"), F.col("vday").cast("string").alias("norm")),
    )
    return got.select(F.col("id").alias(id), F.explode(both).alias("x")).select(id, "x.field", "x.norm").where("norm is not null")
