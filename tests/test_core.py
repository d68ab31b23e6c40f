"""Amounts, identifiers, sources, layout, planner and the registry."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, money, text
from ledgerloom.operators import layout, ledger, rows, sentences, telemetry
from ledgerloom.plans.planner import Capabilities, Capability, Unavailable, ocr_pages, paths_overlap
from ledgerloom.sources import files, tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "cell,want",
    [("1,23,456.50", 123456.5), ("(50.00)", -50), ("-7", -7), ("7-", -7), ("Rs. 1,000/-", 1000), ("₹ 5.25 Cr", 5.25), ("1 250.50", 1250.5), ("5 0", None), ("n/a", None), ("1e5", None), (None, None)],
)
def test_parse_decimal(spark, cell, want):
    got = one(spark, cell, money.parse_decimal)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("cell,want", [("10.00 Dr", -10), ("10.00 Cr", 10), ("10.00 OD", -10), ("-10.00", -10)])
def test_parse_balance(spark, cell, want):
    assert float(one(spark, cell, money.parse_balance)) == want


@pytest.mark.parametrize("value,want", [(1234567.5, "12,34,567.50"), (999.0, "999.00"), (-100000.0, "-1,00,000.00")])
def test_indian_format(spark, value, want):
    assert one(spark, value, money.indian_format, "double") == want


def check_digit(x):
    a = identifiers.BASE36
    total = 0
    for i, ch in enumerate(x[:14], 1):
        p = a.index(ch) * (1 if i % 2 else 2)
        total += p // 36 + p % 36
    return a[(36 - total % 36) % 36]


def test_identifiers(spark):
    body = "27ABCPE1234F1Z"
    good = body + check_digit(body)
    assert one(spark, good, identifiers.verify_gstin) is True
    assert one(spark, body + ("A" if good[-1] != "A" else "B"), identifiers.verify_gstin) is False
    assert one(spark, "A8CD0123456", identifiers.repair_ifsc) == "ABCD0123456"
    assert one(spark, "ABCDO12345S", identifiers.repair_ifsc) == "ABCD012345S"
    assert one(spark, "O12345678S12", identifiers.repair_utr) == ("012345678512", "UPI")
    assert one(spark, "AB5D0123456789O1", identifiers.repair_utr) == ("ABSD012345678901", "NEFT")
    assert one(spark, "ABCPE1234F", identifiers.verify_pan) is True
    assert one(spark, "ABCZE1234F", identifiers.verify_pan) is False
    assert one(spark, "ABCPEI234F", identifiers.repair_pan) == "ABCPE1234F"
    assert one(spark, "1234567890", identifiers.mask_account) == "XXXXXX7890"


def test_text(spark):
    assert one(spark, "Pay Rs 1,000 by 01/02/2024, ref AB12", text.facts) == ["01/02/2024", "ab12", "inr", "1000"]
    assert one(spark, "a  b , c \n\n\n\n d", text.normalise_spacing) == "a b, c\n\nd"
    assert one(spark, "Page 12  of 30", text.header_template) == "page ## of ##"


def test_sentences_lose_nothing():
    for t in ["Rs. 5 was paid. Then Mr. A. Rao left!  Done?", "एक। दो।", "", "no end", "3.14 is pi. Ok."]:
        assert "".join(a + b for a, b in sentences.pieces(t)) == t
    assert [s for s, _ in sentences.pieces("Rs. 5 was paid. Then Mr. A. Rao left!")] == ["Rs. 5 was paid.", "Then Mr. A. Rao left!"]


def test_row_kinds(spark):
    cells = [
        (["01/02/2024", "UPI x", "10.00", "", "90.00"], "TRANSACTION"), (["Date", "Narration", "Debit", "Credit", "Balance"], "HEADER"), (["", "continued text", None, "", ""], "CONTINUATION"),
        (["", "Opening Balance", "", "", "5.00"], "OPENING"), (["", "Closing Balance", "", "", "5.00"], "CLOSING"), (["", "Grand Total", "", "", ""], "SUMMARY"), (["***", "---", "", "", ""], "NOISE"), (["", "EOD Balance", "", "", "5"], "EOD"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cells)], "i int, c array<string>").select("i", rows.row_kind(F.col("c")).alias("k"))
    assert {r.i: r.k for r in df.collect()} == {i: k for i, (_, k) in enumerate(cells)}


def test_running_balance_against_a_loop(spark):
    import random

    rng = random.Random(1)
    data, want = [], {}
    for acct in range(5):
        carried = None
        for seq in range(40):
            d, c = rng.choice([(rng.randrange(100), None), (None, rng.randrange(100))])
            expected = None if carried is None else carried + (c or 0) - (d or 0)
            own = None if rng.random() < 0.3 else rng.randrange(1000) if expected is None or rng.random() < 0.2 else expected
            want[acct, seq] = own is not None and expected is not None and abs(own - expected) >= 0.01
            carried = own if own is not None else expected
            data.append((acct, seq, d, c, own))
    df = spark.createDataFrame(data, "a int, s int, d int, c int, b int")
    for block in (1, 7, 1000):
        got = ledger.running_balance_check(df, ["a"], "s", "d", "c", "b", block=block)
        assert {(r.a, r.s): r.discontinuity for r in got.collect()} == want, block
        back = {(r.a, r.s): (r.expected_back, r.b) for r in ledger.backward_anchor(df.where("b is not null or s <> 39"), ["a"], "s", "d", "c", "b", block=block).collect()}
        for a in range(5):
            last = max(s for k, s in back if k == a)
            assert back[a, last][0] == back[a, last][1]


def test_intraday_reorder(spark):
    data = [("a", 1, None, 30, 160), ("a", 2, None, 50, 130), ("a", 3, 20, None, 80)]
    df = spark.createDataFrame(data, "k string, s int, d int, c int, b int")
    got = ledger.intraday_reorder(df, ["k"], "s", "d", "c", "b")
    assert {r.s: r.position for r in got.collect()} == {3: 1, 2: 2, 1: 3}


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 21)] + [("b", 5)], "k string, v int")
    want = {"a": 20, "b": 5}
    assert {r.k: r.v for r in telemetry.nearest_rank_by(df, ["k"], "v", 0.95).collect()} == want


def test_tables_in_texts(spark):
    df = spark.createDataFrame([(1, 'x\na,b\n1,"2,3"\nq,w,e\n4,5,6\n'), (2, "| h |\n|---|\n| v |\n\ntext\n| lone |"), (3, None)], "i int, t string")
    blocks = {(r.i, r.block_no, r.row_no): r.cells for r in tables.delimited_blocks(df, "i", "t").collect()}
    assert blocks[1, 0, 1] == ["1", "2,3"] and blocks[1, 1, 0] == ["q", "w", "e"]
    marks = {(r.i, r.table_no, r.row_no): r.cells for r in tables.markdown_tables(df, "i", "t").collect()}
    assert marks == {(2, 0, 0): ["h"], (2, 0, 1): ["v"]}
    got, txt = tables.parse_html("<p>hi</p><table><tr><th>a</th></tr><tr><td>1 <b>2</b></td></tr></table><script>x</script>")
    assert got == [("Table_1", [["a"], ["1 2"]])] and "x" not in txt


def workbook():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>head</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    return b.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(workbook())
    (tmp_path / "b.txt").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "c.dat").write_text("a,b\n1,2\n")
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 xl/workbook broken")
    (tmp_path / "~$lock.tmp").write_text("x")
    found = files.discover(spark, str(tmp_path))
    assert sorted(r.format for r in found.collect()) == ["csv", "pdf", "xlsx", "xlsx"]
    got = files.read_office(found).collect()
    assert [r.cells for r in got if r.error is None] == [["head", "", "5"]] and sum(r.error is not None for r in got) == 1


def test_zip_limits():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 5_000_000)
    with pytest.raises(ValueError):
        files.open_zip(b.getvalue())


def test_xy_cut():
    boxes = [(0, 0, 40, 10), (100, 0, 140, 10), (0, 30, 40, 40), (100, 30, 140, 40)]
    assert layout.xy_cut(boxes) == [0, 2, 1, 3]


def test_planner():
    c = Capabilities()
    keep = lambda df: df
    c.register(Capability("read", keep), Capability("bank", keep, ("read",)), Capability("net", keep, grants=frozenset({"network"})))
    assert c.plan(["bank"]) == ["read", "bank"]
    with pytest.raises(ValueError):
        c.register(Capability("new", keep), Capability("bank", keep))
    assert "new" not in c.known
    c.register(Capability("a", keep, ("b",)), Capability("b", keep, ("a",)))
    with pytest.raises(ValueError, match="cycle"):
        c.plan(["a"])
    with pytest.raises(PermissionError):
        c.plan(["net"])
    with pytest.raises(Unavailable):
        ocr_pages()
    assert paths_overlap("/a/b", "/a") and not paths_overlap("/a/bc", "/a/b")


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
