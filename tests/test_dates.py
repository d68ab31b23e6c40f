"""Dates and times of cells: all formats, over every cell."""

import pytest

import __spark_entry__ as e

DAYS = {
    "2024-10-01": "2024-10-01", "2024-10-01 14:30:00": "2024-10-01", "2024-10-01T14:30:00": "2024-10-01", "20241001": "2024-10-01", "2024/10/01": "2024-10-01", "2024.10.1": "2024-10-01", "1/10/2024": "2024-10-01",
    "01.10.2024": "2024-10-01", "01-10-2024": "2024-10-01", "02-02-23": "2023-02-02", "1/2/69": "1969-02-01", "1/2/68": "2068-02-01", "01 Oct 2024": "2024-10-01", "1 october 2024": "2024-10-01", "01-OCT-2024": "2024-10-01",
    "1-October-2024": "2024-10-01", "01102024": "2024-10-01", "01/10/2024 14:30:00": "2024-10-01", "'01/10/2024'": "2024-10-01", "01\xa0Oct 2024": "2024-10-01", "29/02/2023": None, "9-30-22": None, "NA": None, " ": None, None: None,
}
TIMES = {
    "23:59:46": "23:59:46", "00:03": "00:03:00", "9:05": "09:05:00", "01:38:37 PM": "13:38:37", "12:00:01 AM": "00:00:01", "12:00:01 pm": "12:00:01", "1:01 pm": "13:01:00", "12:59 am": "00:59:00", "2024-10-01 14:30:00": "14:30:00",
    "2024-10-01T14:30:00.5": "14:30:00", "01/10/2024 14:30": "14:30:00", "00:02:01.323208": "00:02:01", "00:15:16+05:30": "00:15:16", "00:05:50 UTC": "00:05:50", "01:00:10 PM GMT": "13:00:10", "01:02:09 AM+10:00": "01:02:09",
    "1:34 pm IST": "13:34:00", "13:00:00 PM": "13:00:00", "25:00:00": None, "--": None, "": None, None: None,
}


@pytest.mark.parametrize("query,column,want", [("parse_date", "value_date", DAYS), ("parse_time", "time", TIMES)])
def test_cells(spark, tmp_path, query, column, want):
    spark.createDataFrame(list(enumerate(want)), f"row_id int, {column} string").write.parquet(str(tmp_path / "statement_rows.parquet"))
    got = {r[0]: r[1] for r in e.queries()[query](spark, str(tmp_path)).collect()}
    assert {c: got[i] for i, c in enumerate(want)} == want
