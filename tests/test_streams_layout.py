"""Streams over several files out of order, layouts, the registry cascade, the shared folder, every year of a zone."""

import datetime as dt
import os

import pytest

from ledgerloom.operators import bank_registry, layout
from ledgerloom.operators.timestamps import normalise
from ledgerloom.session import kept, release, shared_dir, written
from ledgerloom.streaming import events as streams

E = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def files(spark, tmp_path, *parts):
    path = str(tmp_path / "events")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, E).coalesce(1).write.parquet(f"{path}/part{n}")
    out = str(tmp_path / "flat")
    os.makedirs(out)
    for n in range(len(parts)):
        name = next(f for f in os.listdir(f"{path}/part{n}") if f.endswith(".parquet"))
        os.rename(f"{path}/part{n}/{name}", f"{out}/{n}.parquet")
        os.utime(f"{out}/{n}.parquet", (1_600_000_000 + n, 1_600_000_000 + n))
    return out


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def test_no_event_is_too_late_by_default(spark, tmp_path):
    new, old = [(1, at(200), 1, "view"), (2, at(200, 1), 1, "view")], [(3, at(0), 1, "view"), (1, at(200), 1, "view"), (4, at(1), 2, "error")]
    stream = lambda p: streams.read_events(spark, p, files_per_batch=1)
    path = files(spark, tmp_path, new, [(5, at(200, 0, 30), 1, "view")], old)
    got, late = streams.drain(streams.hourly(stream(path)).withColumnRenamed("n", "events"), "update")
    assert late == 0 and {r.start_us // 3_600_000_000 for r in got.collect()} == {int(at(d, h).replace(tzinfo=dt.timezone.utc).timestamp()) // 3600 for d, h in ((200, 0), (200, 1), (0, 0), (1, 0))}
    got, late = streams.drain(streams.without_repeats(stream(path)).select("event_id"))
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4, 5] and late == 0
    # with a lateness the events of the last file are left out, and counted
    _, late = streams.drain(streams.hourly(stream(path), "1 day"), "update")
    assert late >= 2


def test_quarantine_and_span_life(spark, tmp_path):
    kinds = ["error", "click", "error", "click", "error", "click", "purchase"]
    path = files(spark, tmp_path, [(i, at(0, i), 1, k) for i, k in enumerate(kinds)] + [(20, at(0), 2, "error"), (21, at(0, 1), 2, "click"), (22, at(0, 2), 2, "purchase"), (30, at(0), 3, "purchase")])
    got = {r.source: (r.state, r.retries) for r in streams.quarantined(spark, path).collect()}
    assert got == {1: ("TERMINAL", 2), 2: ("RELEASED", 1), 3: ("NEW", 0)}


def test_spans_close_in_any_order(spark, tmp_path):
    path = files(spark, tmp_path, [(1, at(0, 5), 1, "purchase"), (2, at(1, 0), 1, "view"), (3, at(3, 0), 2, "view")], [(4, at(0, 1), 1, "view"), (5, at(2, 0), 1, "view")])
    got = {(r.run_id, r.span_id - 19723): r.status for r in streams.span_lives(spark, path).collect()}
    assert got == {(1, 0): "CLOSED", (1, 1): "ORPHANED", (1, 2): "OPEN", (2, 3): "OPEN"}


def test_page_layout(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(1, "Date", (0, 0, 30, 10)), (2, "Amount", (100, 1, 140, 11)), (3, "1 May", (0, 15, 35, 25)), (4, "9.50", (105, 15, 130, 25)), (5, "Note", (0, 60, 30, 70)), (6, None, None), (7, " ", (100, 61, 120, 70))]
    df = spark.createDataFrame([(1, *r[:2], r[2] and tuple(map(float, r[2]))) for r in rows], f"page int, id int, text string, bbox {box}")
    grid = layout.on_grid(df, ["page"], "id", "text", "bbox")
    assert sorted((r.col_no, r.x0, r.x1, r.spans) for r in layout.page_columns(grid, ["page"]).collect()) == [(0, 0.0, 35.0, 3), (1, 100.0, 140.0, 3)]
    assert {r.par_no: r.paragraph for r in layout.paragraphs(grid, ["page"], "id").collect()} == {0: "Date Amount 1 May 9.50", 1: "Note"}
    cells = layout.table_cells(grid, ["page"], "id")
    assert {(r.row_no, r.col_no): r.cell for r in cells.collect()} == {(0, 0): "Date", (0, 1): "Amount", (1, 0): "1 May", (1, 1): "9.50", (2, 0): "Note", (2, 1): ""}
    assert [tuple(r) for r in layout.table_grids(cells, ["page"]).collect()] == [(1, 3, 2, 5)]
    turns = spark.createDataFrame([(1, 0, 0.5, 10), (1, 90, 0.9, 10), (1, 180, 0.9, 10)], "page int, angle int, conf double, chars int")
    assert layout.best_rotation(turns, ["page"], "angle", "conf", "chars").first().angle == 90


def test_registry_cascade(spark):
    cat = spark.createDataFrame([(1, "Orlan Bank Limited"), (2, "The Vestrup Co-operative Bank Ltd."), (3, None)], "bank_id long, bank_name string")
    rows = [(1, "Orlan Bank Limited", "ORLN0001234"), (2, "scan error", "ORLN0001299"), (3, "vestrup cooperative bank", None), (4, "paid via Vestrup Co-operative Bank, Pune", None), (5, "Unknown", "XXXX0000000"), (6, None, None), (7, "x", "ORLN")]
    got = {r.i: (r.bank_id, r.how) for r in bank_registry.resolve(spark.createDataFrame(rows, "i int, name string, code string"), cat, "i", "name", "code").collect()}
    assert got == {1: (1, "CODE_10"), 2: (1, "CODE_8"), 3: (2, "NORMAL_NAME"), 4: (2, "CONTAINED"), 5: (None, None), 6: (None, None), 7: (1, "CODE_4")}
    with pytest.raises(ValueError):
        bank_registry.resolve(spark.createDataFrame(rows, "i int, name string, code string"), cat, "i", "name", "code", max_entries=1)


def test_shared_folder_is_released(spark):
    df = written(spark.range(3))
    assert df.count() == 3 and kept(spark).startswith(shared_dir(spark)) and os.path.isdir(kept(spark).removeprefix("file://"))
    release(spark)
    assert not os.path.exists(f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}".removeprefix("file://"))


@pytest.mark.parametrize("cell,want", [("15/06/1985 10:00", "1985-06-15T14:00:00.000000Z"), ("15/06/2065 10:00", "2065-06-15T14:00:00.000000Z"), ("15/01/2950 10:00", "2950-01-15T15:00:00.000000Z"), ("01/06/1700 12:00", "1700-06-01T16:56:02.000000Z")])
def test_every_year_has_a_zone(spark, cell, want):
    r = spark.createDataFrame([(1, "s", cell, None, None)], "row_id long, statement_id string, date string, time string, value_date string")
    h = spark.createDataFrame([("s", "America/New_York", "DMY")], "statement_id string, source_tz string, date_order string")
    assert [x.norm for x in normalise(r, h).collect()] == [want]
