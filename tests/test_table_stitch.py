"""Rows that page breaks cut in two."""

import __spark_entry__ as e

SCHEMA = "row_id long, statement_id string, page_number int, row_index int, date string, value_date string, time string, description string, reference_number string, debit string, credit string, balance string"
ROWS = [
    # The date goes on after its hyphen.
    (1, "a", 1, 0, "01-02-2024", None, None, "x", None, "1.00", None, "9.00"), (2, "a", 1, 1, "02-02-", None, None, "UPI to", "77", "2.00", None, "7.00"), (3, "a", 2, 0, "2024", None, None, "shop", None, None, None, "Cr"),
    # The page's only row left is a whole one; text goes on over the next break.
    (4, "a", 2, 1, "03/02/2024", None, None, "NEFT", None, "3.00", None, "4.00"), (5, "a", 3, 0, None, None, None, "from home", "R5", None, None, None), (6, "a", 3, 1, "04/02/2024", None, None, "y", None, None, "1.00", "5.00"),
    # Not cut: another date, an amount, three cells, no date above, another statement.
    (7, "a", 4, 0, "05/02/2024", None, None, "z", None, None, "1.00", "6.00"), (8, "a", 5, 0, "", None, None, "fee", None, "1.00", None, None), (9, "a", 6, 0, "", None, None, "t", None, None, None, None),
    (10, "b", 1, 0, "06/02/2024", None, None, "p", None, None, "1.00", "1.00"), (11, "b", 2, 0, None, "q", "r", "s", None, None, None, None), (12, "c", 1, 0, None, None, None, "alone", None, None, None, None),
    # A page that is used up isn't the upper part of another row.
    (13, "d", 1, 0, "07/02/2024", None, None, "m", None, None, "1.00", "1.00"), (14, "d", 2, 0, None, None, None, "n", None, None, None, None), (15, "d", 3, 0, None, None, None, "o", None, None, None, None),
]


def test_rows_are_put_together(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "statement_rows.parquet"))
    got = {r.row_id: tuple(r) for r in e.queries()["table_stitch"](spark, str(tmp_path)).collect()}
    want = {r[0]: (*r, False) for r in ROWS if r[0] not in (3, 5, 14)}
    want[2] = (2, "a", 1, 1, "02-02-2024", None, None, "UPI to shop", "77", "2.00", None, "7.00Cr", True)
    want[4] = (4, "a", 2, 1, "03/02/2024", None, None, "NEFT from home", "R5", "3.00", None, "4.00", True)
    want[13] = (13, "d", 1, 0, "07/02/2024", None, None, "m n", None, None, "1.00", "1.00", True)
    assert got == want
