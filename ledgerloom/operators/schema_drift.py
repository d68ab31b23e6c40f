"""Files of a feed whose columns drift: one consistent table, and a report of each change.

Each column of each file is inferred as a tagged union: how many of its non-empty cells are integers, decimals, dates and
texts. All alternatives are kept: a column whose cells are wholly of one kind has that type, any mixture is text, and an
alternative that a column hadn't in the earlier file is reported, however few cells it has. The unions of all files are fused
by field; the consistent table has a column for each field, with a branch for each alternative that occurs in any file beside
the cell as it stands, and names the fields whose cell has no form of the field's main kind.

Columns are the same from one file to the next if their headers agree without case, blanks and punctuation; what is left over
on both sides is the same if it carries the same field (the mapper's, else the one that other files' mappings show for that
header), or, for headers that no mapping knows, if their words are distributed alike: the share of words (digits alike) that
both have in common, which doesn't depend on the number of rows. Counts are aggregated before anything is shuffled.

Defined results: null and blank cells count for no type; a column without any other cells has no type and is never
retyped. Rows of a mapping repeated under a new id count once. The first file of a feed has no changes. Files without
records only take part by their headers. Of several columns of a file with one field the first is the field, the others are
kept by header. Numbers with more than 28 digits before or 10 after the point are kept as text only, and named. Empty tables
give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written

#: The alternatives of a cell, and the branch that each is converted to.
TAGS = {"integer": "number", "decimal": "number", "date": "date", "text": "text"}
_INTEGER = r"^[+-]?(\d+|\d{1,3}(,\d{2,3})+)$"
_DECIMAL = r"^[+-]?(\d+|\d{1,3}(,\d{2,3})+)\.\d+$"
_DATES = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](\d{4}|\d{2})|\d{1,2}[- ]\p{L}{3,9}[- ,]+(\d{4}|\d{2})|\p{L}{3,9} \d{1,2},? \d{4})$"


def header_key(c: Column) -> Column:
    """A header without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def columns_of(mappings: DataFrame) -> DataFrame:
    """One row per file and column: feed, period, header, its key, and ``ident``, the field it carries (else its key)."""
    m = mappings.select("mapping_id", "feed_id", "file_id", "period_start", "column_index", "source_header", "canonical_field").where(
        F.col("file_id").isNotNull() & F.col("column_index").isNotNull() & F.col("source_header").isNotNull()
    )
    one = m.groupBy("feed_id", "file_id", "column_index").agg(
        F.min_by(F.struct("period_start", "source_header", "canonical_field"), "mapping_id").alias("m")
    )
    cols = one.select("feed_id", "file_id", "column_index", "m.*").withColumn("key", header_key(F.col("source_header")))
    shown = (
        cols.where("canonical_field is not null")
        .groupBy("key", "canonical_field")
        .count()
        .groupBy("key")
        .agg(F.max_by("canonical_field", F.struct("count", "canonical_field")).alias("shown"))
    )
    return cols.join(shown, "key", "left").withColumn("field", F.coalesce("canonical_field", "shown")).drop("shown", "canonical_field")


def tag_of(cell: Column) -> Column:
    """The alternative that a non-empty cell is."""
    return F.when(cell.rlike(_INTEGER), "integer").when(cell.rlike(_DECIMAL), "decimal").when(cell.rlike(_DATES), "date").otherwise("text")


def cell_types(records: DataFrame) -> DataFrame:
    """(file_id, column_index, n_integer, n_decimal, n_date, n_text, type, month_first): the tagged union of each column of each
    file, and whether its dates can only be read with the month in front."""
    cell = F.trim(F.col("cell"))
    cells = records.select("file_id", F.posexplode("cells").alias("column_index", "cell")).where(cell != "")
    number = lambda k: F.regexp_extract(cell, r"^(\d{1,2})[-/.](\d{1,2})[-/.]", k).try_cast("int")
    tagged = cells.select("file_id", "column_index", tag_of(cell).alias("tag"), "cell")
    day, month = F.col("tag") == "date", lambda k: number(k) > 12
    got = tagged.groupBy("file_id", "column_index").agg(
        *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in TAGS], F.count_if(day & month(1)).alias("_first"), F.count_if(day & month(2)).alias("_second")
    )
    return got.withColumn(
        "type",
        F.when(F.col("n_text") > 0, "text")
        .when(F.col("n_date") > 0, F.when(F.col("n_integer") + F.col("n_decimal") > 0, "text").otherwise("date"))
        .when(F.col("n_decimal") > 0, "decimal")
        .otherwise("integer"),
    ).withColumn("month_first", F.col("_second") > F.col("_first")).drop("_first", "_second")


def likeness(rest: DataFrame, records: DataFrame, least: float = 0.5) -> DataFrame:
    """(at, old_ix, new_ix): columns left over on both sides of a comparison, one of them without a known field, whose words are
    distributed alike, best pairs first, each column once. Words are counted per column before they meet; only pairs of
    columns of one comparison that have a word in common are looked at."""
    wanted = rest.select("at", "side", "unknown", F.col("c.file_id").alias("file_id"), F.col("c.column_index").alias("column_index"))
    cells = records.select("file_id", F.posexplode("cells").alias("column_index", "cell")).where(F.trim("cell") != "")
    cells = cells.join(wanted.select("file_id", "column_index").distinct(), ["file_id", "column_index"], "left_semi")
    words = cells.select("file_id", "column_index", F.explode(F.split(F.regexp_replace(F.lower(F.trim("cell")), r"\d", "9"), r"\s+")).alias("word"))
    counts = words.groupBy("file_id", "column_index", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("file_id", "column_index").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, ["file_id", "column_index"]).select("file_id", "column_index", "word", (F.col("n") / F.col("all")).alias("share"))
    placed = wanted.join(shares, ["file_id", "column_index"])
    side = lambda x: placed.where(F.col("side") == x).select("at", "word", *[F.col(c).alias(f"{x}_{c}") for c in ("unknown", "column_index", "share")])
    both = side("old").join(side("new"), ["at", "word"]).where("old_unknown or new_unknown")
    pairs = both.groupBy("at", F.col("old_column_index").alias("old_ix"), F.col("new_column_index").alias("new_ix")).agg(F.sum(F.least("old_share", "new_share")).alias("shared"))

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        out, old, new = [], set(), set()
        for r in f.sort_values(["shared", "old_ix", "new_ix"], ascending=[False, True, True]).itertuples():
            if r.old_ix not in old and r.new_ix not in new:
                old.add(r.old_ix)
                new.add(r.new_ix)
                out.append((r.at, r.old_ix, r.new_ix))
        return pd.DataFrame(out, columns=["at", "old_ix", "new_ix"])

    # as many rows a group as the two files have columns that look alike
    return pairs.where(F.col("shared") >= least).groupBy("at").applyInPandas(choose, "at long, old_ix int, new_ix int")


def changes(mappings: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, source_header, change_kind): each change against the file of the same feed with the next earlier period."""
    cols = columns_of(mappings).join(cell_types(records), ["file_id", "column_index"], "left")
    cols = cols.select(
        "feed_id", "file_id", "period_start", "column_index", "source_header", "key", "field", "type",
        F.row_number().over(Window.partitionBy("file_id", "key").orderBy("column_index")).alias("nth"),
    )
    # a row per file and column: the records are read once, and what follows is small beside them
    cols = written(cols)
    files = cols.groupBy("feed_id", "file_id").agg(F.min("period_start").alias("period_start")).where("period_start is not null")
    in_time = Window.partitionBy("feed_id").orderBy("period_start", "file_id")
    # which file a file is compared with, and which one is compared with it
    steps = files.select(
        "feed_id", "file_id", F.lag("file_id").over(in_time).alias("earlier"), F.lead("file_id").over(in_time).alias("later")
    )
    both = cols.join(steps, ["feed_id", "file_id"])
    sides = both.select(
        F.explode(
            F.array(
                F.struct(F.when(F.col("earlier").isNotNull(), F.col("file_id")).alias("at"), F.lit("new").alias("side")),
                F.struct(F.col("later").alias("at"), F.lit("old").alias("side")),
            )
        ).alias("s"),
        "key", "nth", "field", F.struct("source_header", "type", "column_index", "file_id").alias("c"),
    ).select("s.at", "s.side", "key", "nth", "field", "c").where("at is not null")
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}")
    by_header = written(sides.groupBy("at", "key", "nth").agg(of("old", "c"), of("new", "c"), F.max("field").alias("field")))
    retyped = (F.col("old.type") != F.col("new.type")) & F.col("old.type").isNotNull() & F.col("new.type").isNotNull()
    stays = F.col("old").isNotNull() & F.col("new").isNotNull()
    left = by_header.where(~stays).select("at", "key", "field", F.when(F.col("old").isNull(), "new").otherwise("old").alias("side"), F.coalesce("old", "new").alias("c"))
    left = left.withColumn("nth", F.row_number().over(Window.partitionBy("at", "field", "side").orderBy("c.column_index")))
    unknown = F.col("field").isNull()
    by_field = left.where(~unknown).groupBy("at", "field", "nth").agg(of("old", "c"), of("new", "c"))
    # headers without any known field, against what is still left over on the other side of the same file
    rest = by_field.where(~stays).select(
        "at", F.lit(False).alias("unknown"), F.when(F.col("old").isNull(), "new").otherwise("old").alias("side"), F.coalesce("old", "new").alias("c")
    ).unionByName(left.where(unknown).select("at", F.lit(True).alias("unknown"), "side", "c"))
    rest = written(rest)
    pair = likeness(rest, records)
    of_side = lambda x: rest.where(F.col("side") == x).select("at", F.col("c.column_index").alias(f"{x}_ix"), F.col("c").alias(x))
    alike = written(pair.join(of_side("old"), ["at", "old_ix"]).join(of_side("new"), ["at", "new_ix"]).select("at", "old", "new"))
    matched = alike.select("at", F.explode(F.array(F.struct(F.lit("old").alias("side"), "old.column_index"), F.struct(F.lit("new").alias("side"), "new.column_index"))).alias("m"))
    matched = matched.select("at", "m.side", F.col("m.column_index").alias("ix"))
    alone = rest.withColumn("ix", F.col("c.column_index")).join(matched, ["at", "side", "ix"], "left_anti")
    renamed = by_field.where(stays).select("at", "old", "new").unionByName(alike.select("at", "old", "new"))
    both_kinds = F.array_compact(F.array(F.lit("renamed"), F.when(retyped, F.lit("retyped"))))
    out = (
        by_header.where(stays & retyped).select("at", "new.source_header", F.lit("retyped").alias("change_kind"))
        .unionByName(renamed.select("at", "new.source_header", F.explode(both_kinds).alias("change_kind")))
        .unionByName(alone.select("at", "c.source_header", F.when(F.col("side") == "new", "added").otherwise("removed").alias("change_kind")))
    )
    return out.withColumnRenamed("at", "file_id")


def alternatives(mappings: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, source_header, alternative, cells): alternatives that a column has in a file, but not in the earlier file of
    its feed with cells under that field (or, without one, that header)."""
    cols = columns_of(mappings).join(cell_types(records), ["file_id", "column_index"]).withColumn("ident", F.coalesce("field", "key"))
    one = cols.groupBy("feed_id", "file_id", "ident").agg(
        F.min("period_start").alias("period_start"), F.min_by("source_header", "column_index").alias("source_header"), *[F.sum(f"n_{t}").alias(f"n_{t}") for t in TAGS]
    ).where("period_start is not null")
    in_time = Window.partitionBy("feed_id", "ident").orderBy("period_start", "file_id")
    one = one.withColumns({f"before_{t}": F.lag(f"n_{t}").over(in_time) for t in TAGS})
    shown = F.array_compact(F.array(*[F.when((F.col(f"n_{t}") > 0) & (F.col(f"before_{t}") == 0), F.struct(F.lit(t).alias("alternative"), F.col(f"n_{t}").alias("cells"))) for t in TAGS]))
    return one.select("file_id", "source_header", F.explode(shown).alias("x")).select("file_id", "source_header", "x.alternative", "x.cells")


def as_number(c: Column) -> Column:
    """An exact decimal from the notations that occur: grouped digits, a trailing Dr (negative) or Cr; null if it has more
    digits than fit."""
    x = F.regexp_replace(F.trim(c), r"[, ]|(?i)(cr|dr)\.?$", "")
    n = F.when(x.rlike(r"^[+-]?\d{1,28}(\.\d{1,10})?$"), x.try_cast("decimal(38,10)"))
    return F.when(F.trim(c).rlike(r"(?i)dr\.?$"), -n).otherwise(n)


def as_date(c: Column, month_first: Column | bool = False) -> Column:
    """A day from the notations that occur; ten digits are seconds since 1970. ``month_first`` says how days and months that
    could be either are read."""
    x = F.regexp_replace(F.trim(c), r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{1,4})$", "$1-$2-$3")
    order = F.lit(month_first) if isinstance(month_first, bool) else F.coalesce(month_first, F.lit(False))
    numeric = F.when(order, F.coalesce(F.try_to_date(x, "M-d-yyyy"), F.try_to_date(x, "M-d-yy"))).otherwise(F.coalesce(F.try_to_date(x, "d-M-yyyy"), F.try_to_date(x, "d-M-yy")))
    iso = F.when(x.rlike(r"^\d{4}-"), F.try_to_date(x, "yyyy-M-d"))
    short = F.when(x.rlike(r"-\d{2}$"), F.when(order, F.try_to_date(x, "M-d-yy")).otherwise(F.try_to_date(x, "d-M-yy")))
    words = F.regexp_replace(F.regexp_replace(x, r"[-, ]+", " "), r"(\p{L}{3})\p{L}*", "$1")
    return F.coalesce(
        iso, short, numeric, *[F.try_to_date(words, f) for f in ("d MMM yyyy", "d MMM yy", "MMM d yyyy")], F.when(x.rlike(r"^\d{10}$"), F.to_date(F.timestamp_seconds(x.try_cast("long"))))
    )


def unify(mappings: DataFrame, records: DataFrame, max_fields: int = 2000) -> DataFrame:
    """One row per record: ids, and for each field of any file a struct: the cell as it stands (``text``), and a branch for each
    alternative that any file has for the field (``number`` exact, ``date``), filled where the cell is of that alternative.
    ``unparsed`` names the fields whose cell has no form of the field's main kind; other columns are kept by header in
    ``others``. More than ``max_fields`` fields are refused, as each is a column."""
    cols = columns_of(mappings)
    nth = F.row_number().over(Window.partitionBy("file_id", "field").orderBy("column_index"))
    cols = written(cols.join(cell_types(records), ["file_id", "column_index"], "left").withColumn("is_field", F.col("field").isNotNull() & (nth == 1)))
    fused = cols.where("is_field").groupBy("field").agg(*[F.coalesce(F.sum(f"n_{t}"), F.lit(0)).alias(f"n_{t}") for t in TAGS]).orderBy("field").limit(max_fields + 1).collect()
    if len(fused) > max_fields:
        raise ValueError(f"more than {max_fields} fields")
    layout = cols.groupBy("feed_id", "file_id").agg(
        F.min("period_start").alias("period_start"),
        F.map_from_entries(F.collect_list(F.when(F.col("is_field"), F.struct("field", F.struct("column_index", "month_first"))))).alias("at"),
        F.collect_list(F.when(~F.col("is_field"), F.struct("source_header", "column_index"))).alias("rest"),
    )
    got = records.select("record_id", "file_id", "row_no", "cells").join(layout, "file_id", "left")
    fields, unparsed = [], []
    for r in fused:
        place = F.try_element_at("at", F.lit(r.field))
        cell = F.get("cells", place["column_index"])
        number, day = as_number(cell), as_date(cell, place["month_first"])
        n = {"number": r.n_integer + r.n_decimal, "date": r.n_date, "text": r.n_text}
        parts = [cell.alias("text")] + [x.alias(k) for k, x in (("number", number), ("date", day)) if n[k]]
        fields.append(F.struct(*parts).alias(r.field))
        main = max(("text", "number", "date"), key=lambda k: n[k])
        if main != "text":
            unparsed.append(F.when((F.trim(cell) != "") & (number if main == "number" else day).isNull(), r.field))
    others = F.transform("rest", lambda r: F.struct(r["source_header"].alias("header"), F.get("cells", r["column_index"]).alias("text")))
    named = F.array_compact(F.array(*unparsed)) if unparsed else F.array().cast("array<string>")
    return got.select("record_id", "file_id", "row_no", "feed_id", "period_start", *fields, named.alias("unparsed"), others.alias("others"))
