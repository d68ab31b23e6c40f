"""p5: changes against a plain comparison, and edge cases."""

import datetime as dt

from ledgerloom.operators.schema_drift import alternatives, changes, unify

M = "mapping_id long, feed_id long, file_id long, period_start date, column_index int, source_header string, canonical_field string, other string"
R = "record_id long, file_id long, row_no int, cells array<string>, other string"


def frames(spark, files):
    """files: (file_id, month, [(header, field)], rows)."""
    m, r, n = [], [], 0
    for f, month, cols, rows in files:
        for i, (h, c) in enumerate(cols):
            n += 1
            m.append((n, 1, f, dt.date(2024, month, 1), i, h, c, None))
        r += [(f * 100 + k, f, k, row, None) for k, row in enumerate(rows)]
    return spark.createDataFrame(m, M), spark.createDataFrame(r, R)


def run(spark, files):
    return sorted((x.file_id, x.source_header, x.change_kind) for x in changes(*frames(spark, files)).collect())


def test_kinds_of_change(spark):
    files = [
        (2, 2, [("AMOUNT.", "debit"), ("Narration", "description"), ("Teller", None), ("Day", "date")], [["1.5", "b", "T9", "2024-01-02"]]),
        (1, 1, [("Amount", "debit"), ("Particulars", "description"), ("Remarks", None), ("Day", "date")], [["10", "a", "late", "02/01/2024"], [None, "", "ok", None]]),
    ]
    assert run(spark, files) == [(2, "AMOUNT.", "retyped"), (2, "Narration", "renamed"), (2, "Remarks", "removed"), (2, "Teller", "added")]


def test_renamed_and_retyped_without_mapping(spark):
    """A header that the mapper missed takes the field that other files show for it."""
    files = [(1, 1, [("Debit", "debit")], [["1.00"]]), (2, 2, [("Paid Out", None)], [["1.00 Dr"]]), (9, 3, [("Paid Out", "debit")], [["2 Dr"]])]
    assert run(spark, files) == [(2, "Paid Out", "renamed"), (2, "Paid Out", "retyped")]


def test_alike_without_any_field(spark):
    files = [(1, 1, [("Desk", None)], [["T12"], ["T13"]]), (2, 2, [("Counter", None)], [["T55"], ["T56"]])]
    assert run(spark, files) == [(2, "Counter", "renamed")]


def test_empty_columns_and_tables(spark):
    assert run(spark, [(1, 1, [("A", None)], [["1"]]), (2, 2, [("A", None)], [[None], [""]])]) == []
    assert changes(spark.createDataFrame([], M), spark.createDataFrame([], R)).count() == 0


def test_repeated_mappings_count_once(spark):
    m, r = frames(spark, [(1, 1, [("A", "debit")], [["1"]]), (2, 2, [("B", "debit")], [["1"]])])
    again = m.selectExpr("mapping_id + 1000 as mapping_id", *[c for c in m.columns if c != "mapping_id"])
    assert [tuple(x) for x in changes(m.unionByName(again), r).collect()] == [(2, "B", "renamed")]


def test_unlike_columns_are_no_renames(spark):
    """Two free-text columns of many rows don't become one because both hold many shapes."""
    one = [[f"paid to shop {i} near lake {i % 7}"] for i in range(400)]
    two = [[f"ticket {i} raised by desk officer"] for i in range(400)]
    same = [[f"paid to shop {i + 900} near lake {i % 5}"] for i in range(50)]
    assert run(spark, [(1, 1, [("Foo", None)], one), (2, 2, [("Bar", None)], two)]) == [(2, "Bar", "added"), (2, "Foo", "removed")]
    assert run(spark, [(1, 1, [("Foo", None)], one), (2, 2, [("Bar", None)], same)]) == [(2, "Bar", "renamed")]


def test_every_column_is_paired_once(spark):
    """A column that is the second best of two takes what the best one leaves."""
    old = [["a b c", "a b d"]] * 3
    new = [["a b c", "a b e"]] * 3
    files = [(1, 1, [("P", None), ("Q", None)], old), (2, 2, [("R", None), ("S", None)], new)]
    assert run(spark, files) == [(2, "R", "renamed"), (2, "S", "renamed")]


def test_appearing_alternatives(spark):
    rows = [[str(i)] for i in range(99)]
    files = [(1, 1, [("N", "debit")], rows), (2, 2, [("N", "debit")], [*rows, ["n.a. yet"]]), (3, 3, [("N", "debit")], [*rows, ["soon"], ["1.5"]])]
    got = sorted(tuple(r) for r in alternatives(*frames(spark, files)).collect())
    assert got == [(2, "N", "text", 1), (3, "N", "decimal", 1)]


def test_unified_table(spark):
    m, r = frames(spark, [(1, 1, [("Amount", "debit"), ("Day", "date"), ("Desk", None)], [["1,23,456.3456 Dr", "02/01/2024", "T1"], ["12.25", "3/1/2024", ""], ["7", "no day", None], ["1.5", "4/1/2024"]])])
    x = {r.row_no: r for r in unify(m, r).collect()}
    assert str(x[0].debit.number) == "-123456.3456000000" and str(x[0].date.date) == "2024-01-02" and x[0].others[0].text == "T1"
    assert x[2].date.text == "no day" and x[2].date.date is None and x[2].unparsed == ["date"] and x[0].unparsed == [] and x[3].others[0].text is None


def test_two_columns_of_one_field(spark):
    files = [(1, 1, [("Amount", "debit"), ("Amount again", "debit"), ("Day", "date")], [["1", "2", "12/25/2023"], ["3", "4", "01/02/2024"]]), (2, 2, [("Extra", "credit")], [["5"]])]
    x = {(r.file_id, r.row_no): r for r in unify(*frames(spark, files)).collect()}
    assert int(x[1, 0].debit.number) == 1 and x[1, 0].others[0].header == "Amount again" and x[1, 0].others[0].text == "2" and x[1, 0].credit.text is None
    # the first date shows the order of both
    assert [str(x[1, k].date.date) for k in (0, 1)] == ["2023-12-25", "2024-01-02"] and int(x[2, 0].credit.number) == 5
