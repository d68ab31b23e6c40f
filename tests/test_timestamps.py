"""p3: every notation, zones, daylight-saving edges, nulls, ties and empty tables."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from ledgerloom.operators.timestamps import normalise

ROWS = "row_id long, statement_id string, date string, time string, value_date string, extra string"
HEADS = "statement_id string, source_tz string, date_order string, extra string"


def run(spark, rows, heads):
    r = spark.createDataFrame([(i, "s", *x, None) for i, x in enumerate(rows)], ROWS)
    return {(x.row_id, x.field): x.norm for x in normalise(r, spark.createDataFrame(heads, HEADS)).collect()}


@pytest.mark.parametrize("order,cell,day", [("DMY", "05-03-24", "2024-03-05"), ("MDY", "05/03/2024", "2024-05-03"), ("YMD", "20240305", "2024-03-05")])
def test_order(spark, order, cell, day):
    assert run(spark, [(cell, None, cell)], [("s", "Asia/Kolkata", order, "x")]) == {(0, "date"): day, (0, "value_date"): day}


def test_notations_and_zones(spark):
    rows = [
        ("01 मई 2022", "10:07 pm", "May 4, 2022"),
        ("2022-05-01T10:00", None, "04-MAY-22"),
        ("2022-05-01 10:00:00.5 +0900", "--", "44682"),
        ("1651399200", None, "NA"),
        ("44682.25", None, ""),
        ("१/५/२०२२", "१०h०५", None),
        ("1.5.2022", "101112 UTC+1:00", "31/02/2024"),
        ("2023-13-45", "10:00", None),
        ("1.5.2022", "25:00", None),
        (None, "10:00", None),
    ]
    got = run(spark, rows, [("s", "Asia/Kolkata", "DMY", "x")])
    assert got == {
        (0, "date"): "2022-05-01T16:37:00.000000Z", (0, "value_date"): "2022-05-04",
        (1, "date"): "2022-05-01T04:30:00.000000Z", (1, "value_date"): "2022-05-04",
        (2, "date"): "2022-05-01T01:00:00.500000Z", (2, "value_date"): "2022-05-01",
        (3, "date"): "2022-05-01T10:00:00.000000Z", (4, "date"): "2022-05-01T00:30:00.000000Z",
        (5, "date"): "2022-05-01T04:35:00.000000Z", (6, "date"): "2022-05-01T09:11:12.000000Z",
    }


def test_daylight_saving_edges(spark):
    rows = [("2023-10-29", "02:30", None), ("2023-10-29", "02:30 CET", None), ("2023-03-26", "02:30", None), ("2023-03-26", "03:30", None)]
    got = run(spark, rows, [("s", "Europe/Paris", "DMY", "x")])
    assert got == {(1, "date"): "2023-10-29T01:30:00.000000Z", (3, "date"): "2023-03-26T01:30:00.000000Z"}


def test_no_zone_and_unknown_zone(spark):
    assert run(spark, [("2023-01-01", "10:00", None), ("2023-01-01", "10:00 GMT", None)], [("s", None, None, "x")]) == {(1, "date"): "2023-01-01T10:00:00.000000Z"}
    assert run(spark, [("2023-01-01", "10:00", "2023-01-02")], [("s", "Mars/Base", None, "x")]) == {(0, "value_date"): "2023-01-02"}


def test_order_is_borne_out(spark):
    got = run(spark, [("04/05/2023", None, None), ("13/05/2023", None, None)], [("s", None, None, "x")])
    assert got[0, "date"] == "2023-05-04"


def test_against_zoneinfo(spark):
    rng = random.Random(3)
    zones = ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata"]
    rows, heads, want = [], [], {}
    for i in range(120):
        z = rng.choice(zones)
        t = dt.datetime(2023, 1, 1) + dt.timedelta(minutes=rng.randrange(365 * 24 * 60))
        heads.append((f"s{i}", z, "YMD", None))
        rows.append((i, f"s{i}", t.strftime("%Y-%m-%d"), t.strftime("%H:%M"), None, None))
        both = {t.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(dt.timezone.utc) for f in (0, 1)}
        if len(both) == 1 and next(iter(both)).astimezone(ZoneInfo(z)).replace(tzinfo=None) == t:
            want[i] = next(iter(both)).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    got = normalise(spark.createDataFrame(rows, ROWS), spark.createDataFrame(heads, HEADS)).where("field = 'date'").collect()
    assert {x.row_id: x.norm for x in got} == want


def test_empty(spark):
    assert normalise(spark.createDataFrame([], ROWS), spark.createDataFrame([], HEADS)).count() == 0
