"""Tables inside texts: delimited blocks, Markdown, HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")


def sniff_delimiter(text: Column) -> Column:
    """The delimiter most lines of the first 4 KB have, the first listed on ties; null if fewer than two lines have any."""
    lines = F.split(F.substring(text, 1, 4096), r"\r?\n")
    n = lambda d: F.size(F.filter(lines, lambda x: x.contains(d)))
    ranked = F.array(*[F.struct(n(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    best = F.array_max(ranked)
    return F.when(best["n"] >= 2, best["d"])


def delimited_blocks(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, block_no, row_no, cells): runs of rows with one number of columns, two rows at least; row 0 of a block is its
    header. Quoted delimiters don't count. Texts without a delimiter give no rows."""
    quoted = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    x = df.select(F.col(id).alias("id"), F.col(text).alias("t")).withColumn("d", sniff_delimiter(F.col("t"))).where("d is not null")
    lines = x.select("id", "d", F.posexplode(F.split("t", r"\r?\n")).alias("n", "line")).where("trim(line) <> ''")
    cut = F.lit(None)
    for d in DELIMITERS:
        pattern = ("\\|" if d == "|" else d) + quoted
        cut = F.when(F.col("d") == d, F.split("line", pattern)).otherwise(cut) if d != "," else F.split("line", pattern)
    cells = F.transform(cut, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))
    rows = lines.withColumn("cells", cells).withColumn("k", F.size("cells")).where("k > 1")
    w = Window.partitionBy("id").orderBy("n")
    rows = rows.withColumn("b", F.sum(F.when(F.col("k") != F.lag("k").over(w), 1).otherwise(0)).over(w))
    whole = Window.partitionBy("id", "b")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(whole)).where("size >= 2").withColumn("row_no", F.row_number().over(whole.orderBy("n")) - 1)
    return rows.select(F.col("id").alias(id), (F.dense_rank().over(Window.partitionBy("id").orderBy("b")) - 1).alias("block_no"), "row_no", "cells")


def markdown_tables(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, table_no, row_no, cells): runs of two or more lines in bars; a separator line is no row, row 0 is the header."""
    lines = df.select(F.col(id).alias("id"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    bars = lines.where(F.trim("line").rlike(r"^\|.*\|$"))
    w = Window.partitionBy("id").orderBy("n")
    runs = bars.withColumn("g", F.col("n") - F.row_number().over(w))
    kept = runs.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("id", "g"))).where("size >= 2").where(~F.trim("line").rlike(r"^\|[ :|-]*-[ :|-]*\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return kept.select(
        F.col("id").alias(id), (F.dense_rank().over(Window.partitionBy("id").orderBy("g")) - 1).alias("table_no"),
        (F.row_number().over(Window.partitionBy("id", "g").orderBy("n")) - 1).alias("row_no"), cells.alias("cells"),
    )


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[list[str]]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None
        self.text: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.open.append(len(self.tables))
            self.tables.append((a.get("id") or a.get("name") or f"Table_{len(self.tables) + 1}", []))
        elif tag == "tr" and self.open:
            self.tables[self.open[-1]][1].append([])
        elif tag in ("td", "th") and self.open and self.tables[self.open[-1]][1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.cell is not None and self.open:
            self.tables[self.open[-1]][1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        if data.strip():
            self.text.append(data.strip())


def parse_html(html: str) -> tuple[list[tuple[str, list[list[str]]]], str]:
    """(tables, text) of a page; row 0 of a table is its header."""
    p = _Tables()
    p.feed(html)
    p.close()
    return [(n, [r for r in rows if r]) for n, rows in p.tables], "\n".join(p.text)


def html_tables(df: DataFrame, id: str, html: str) -> DataFrame:
    """(id, table_no, name, row_no, cells) of every table in the pages."""
    rows = df.select(F.col(id).alias("id"), F.col(html).alias("html")).where("html is not null")
    kind = dict(rows.dtypes)["id"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, k, name, n, cells) for i, h in zip(f["id"], f["html"]) for k, (name, rs) in enumerate(parse_html(h)[0]) for n, cells in enumerate(rs)]
            yield pd.DataFrame(out, columns=["id", "table_no", "name", "row_no", "cells"])

    return rows.mapInPandas(work, f"id {kind}, table_no int, name string, row_no int, cells array<string>").withColumnRenamed("id", id)
