"""Positioned spans: lines, cells, columns and reading order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(x: Column, centres: Sequence[float]) -> Column:
    """The centre next to ``x``; the first of two equally near."""
    options = F.array(*[F.struct(F.abs(x - F.lit(c)).alias("d"), F.lit(float(c)).alias("c")) for c in centres])
    return F.array_min(options)["c"]


def cell_of(df: DataFrame, box: str, width: float, height: float) -> DataFrame:
    """``df`` with the grid cell that holds the middle of ``box``: a range join as plain arithmetic."""
    b = F.col(box)
    return df.withColumn("col_ix", F.floor((b["x0"] + b["x1"]) / 2 / width)).withColumn("row_ix", F.floor((b["y0"] + b["y1"]) / 2 / height))


def lines_from_spans(df: DataFrame, keys: Sequence[str], id: str, text: str, box: str, height: float = 12.0, gap: float = 0.2) -> DataFrame:
    """(keys, line_no, line): spans of one height band, left to right, with a blank where the gap is a fifth of the height."""
    b = F.col(box)
    x = df.where(F.col(box).isNotNull() & F.col(text).isNotNull())
    span = F.struct(b["x0"].alias("x0"), F.col(id).alias("id"), b["x1"].alias("x1"), F.col(text).alias("t"))
    banded = x.groupBy(*keys, F.floor(b["y0"] / height).alias("line_no")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    joined = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("x")),
        lambda acc, s: F.struct(
            F.concat(acc["t"], F.when(acc["x"].isNotNull() & (s["x0"] - acc["x"] >= gap * height), " ").otherwise(""), F.trim(s["t"])).alias("t"), s["x1"].alias("x")
        ),
    )
    return banded.select(*keys, "line_no", joined["t"].alias("line"))


def xy_cut(boxes: list[tuple], least_x: float = 15.0, least_y: float = 12.0) -> list[int]:
    """Indexes of (x0, y0, x1, y1) in reading order: cut at the widest vertical gap first, else at horizontal ones."""
    if len(boxes) < 2:
        return list(range(len(boxes)))
    tall = sorted(b[3] - b[1] for b in boxes)[len(boxes) // 2]
    limits = {0: max(least_x, 0.75 * tall), 1: max(least_y, 0.75 * tall)}

    def cut(ids: list[int]) -> list[int]:
        if len(ids) < 2:
            return ids
        for axis in (0, 1):
            order = sorted(ids, key=lambda i: boxes[i][axis])
            edge, best, at = boxes[order[0]][axis + 2], limits[axis], 0
            for k, i in enumerate(order[1:], 1):
                if boxes[i][axis] - edge >= best:
                    best, at = boxes[i][axis] - edge, k
                edge = max(edge, boxes[i][axis + 2])
            if at:
                return cut(order[:at]) + cut(order[at:])
        return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0], i))

    return cut(list(range(len(boxes))))


def reading_order(df: DataFrame, keys: Sequence[str], id: str, box: str) -> DataFrame:
    """(keys, id, position) by recursive cuts of each page; spans without a box come last. A page is one group."""
    flat = df.select(*keys, id, *[F.col(box)[c].alias(c) for c in ("x0", "y0", "x1", "y1")])

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id).reset_index(drop=True)
        placed = rows.dropna(subset=["x0", "y0", "x1", "y1"])
        order = xy_cut(list(placed[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)))
        ranked = placed.iloc[order][id].tolist() + rows.loc[~rows.index.isin(placed.index), id].tolist()
        where = {v: n for n, v in enumerate(ranked, 1)}
        rows["position"] = rows[id].map(where)
        return rows[[*keys, id, "position"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.select(*keys, id).schema.fields) + ", position int"
    return flat.groupBy(*keys).applyInPandas(page, schema)


def islands(df: DataFrame, keys: Sequence[str], start: Column, end: Column, order: Sequence[Column | str], gap: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the number of the run of intervals that each belongs to: a new one begins where ``start`` lies more
    than ``gap`` beyond all ends before it. A page is one group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNotNull() & (start - F.col("_reach") > gap), 1).otherwise(0)
    return x.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_reach", "_new")


def on_grid(df: DataFrame, keys: Sequence[str], id: str, text: str, box: str) -> DataFrame:
    """(keys, id, t, x0, y0, x1, y1, h, row_no, col_no, par_no): the spans of each page with their line (spans whose heights overlap),
    their column (between gutters of 15, or three quarters of the middle height, that run down the whole page) and their
    paragraph (lines without a gap of three quarters of the middle height)."""
    b = F.col(box)
    flat = df.where(b.isNotNull()).select(*keys, id, F.col(text).alias("t"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")])
    tall = flat.groupBy(*keys).agg(F.percentile(F.col("y1") - F.col("y0"), 0.5).alias("h"))
    flat = flat.join(tall, list(keys))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    flat = islands(flat, keys, x0, x1, ["x0", id], F.greatest(F.lit(15.0), F.col("h") * 0.75), "col_no")
    flat = islands(flat, keys, y0, y1, ["y0", id], F.lit(0.0), "row_no")
    return islands(flat, keys, y0, y1, ["y0", id], F.col("h") * 0.75, "par_no")


def page_columns(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, col_no, x0, x1, spans): the columns of each page."""
    return grid.groupBy(*keys, "col_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("spans"))


def _joined(*order: str) -> Column:
    parts = F.array_sort(F.collect_list(F.when(F.trim("t") != "", F.struct(*order, F.trim("t").alias("t")))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), " ")


def paragraphs(grid: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """(keys, par_no, spans, paragraph): the paragraphs of each page, spans line by line and from left to right."""
    return grid.groupBy(*keys, "par_no").agg(F.count(F.lit(1)).alias("spans"), _joined("row_no", "x0", id).alias("paragraph"))


def table_cells(grid: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """(keys, row_no, col_no, cell): the table that the lines and columns of each page make."""
    return grid.groupBy(*keys, "row_no", "col_no").agg(_joined("x0", id).alias("cell"))


def table_grids(cells: DataFrame, keys: Sequence[str], least: float = 0.6) -> DataFrame:
    """(keys, rows, columns, filled): pages whose lines and columns make a table: two of each at least, and the share ``least`` of
    its cells filled."""
    x = cells.groupBy(*keys).agg(F.count_distinct("row_no").alias("rows"), F.count_distinct("col_no").alias("columns"), F.count_if(F.col("cell") != "").alias("filled"))
    return x.where((F.col("rows") >= 2) & (F.col("columns") >= 2) & (F.col("filled") >= least * F.col("rows") * F.col("columns")))


def inside(spans: DataFrame, regions: DataFrame, keys: Sequence[str], box: str, slack: float = 3.0) -> DataFrame:
    """Spans whose middle lies in a region (rx0, ry0, rx1, ry1) of their page, within ``slack``. A page has few regions."""
    b = F.col(box)
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    hit = (cx >= F.col("rx0") - slack) & (cx <= F.col("rx1") + slack) & (cy >= F.col("ry0") - slack) & (cy <= F.col("ry1") + slack)
    return spans.join(regions, list(keys)).where(hit)


def best_rotation(candidates: DataFrame, keys: Sequence[str], angle: str, confidence: str, chars: str) -> DataFrame:
    """(keys, angle): the rotation whose reading has most characters, weighted by confidence; the smaller angle on ties."""
    return candidates.groupBy(*keys).agg(F.max_by(angle, F.struct(F.col(confidence) * F.col(chars), -F.col(angle))).alias(angle))
