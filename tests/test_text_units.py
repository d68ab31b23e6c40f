"""Protection, legacy fonts, statutory extraction and streams."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import legacy, protect
from ledgerloom.operators import statutory
from ledgerloom.streaming import events as streams
from tests.test_core import check_digit


def test_protect_and_restore():
    rng = random.Random(1)
    bits = ["Pay Rs. 1,200", "a.b@c.org", "01/02/2024", "REF12X9", "18%", "http://x.y/z?q=1", "plain words", "७", "5"]
    for _ in range(100):
        t = " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))
        p, spans = protect.protect(t)
        assert protect.restore(p, spans) == (t, [])
    p, spans = protect.protect("ref AB12CD")
    assert protect.restore(p.replace(spans[0]["placeholder"], ""), spans)[1] == [spans[0]["placeholder"]]


def test_units_lose_nothing():
    t = "One. Two is longer. Three!\n\nNext para. End"
    assert "".join(protect.clauses(t, 12)) == t.replace("\n\n", "\n", 0) or "".join(protect.clauses(t, 12)).replace("\n", "") == t.replace("\n", "")
    assert " ".join(protect.chunks("a b c d e", 2)) == "a b c d e"
    assert "".join(b for _, b in protect.script_segments("abc १२ कख, x")) == "abc १२ कख, x"
    assert protect.word_error_rate("a b c", "a x c") == 1 / 3 and protect.word_error_rate("", "x") is None
    assert protect.transliterate("kamal") == "कमल"


def test_legacy_round_trip():
    for t in ["कमल", "किताब", "कर्म", "भारत का नाम", "शाखा में राशि", "वर्षा"]:
        assert legacy.convert(legacy.reverse(t)) == t, t
    assert legacy.convert("esa") == "में" and legacy.convert("dey") == "कमल" and legacy.convert("fdrkc") == "किताब" and legacy.convert("deZ") == "कर्म"
    assert legacy.mac_repair("ÈtÈ") == "été"


def test_legacy_expressions(spark):
    df = spark.createDataFrame([(1, "esa gS dh dks vkSj"), (2, "plain text"), (3, "में है"), (4, "ा क््"), (5, None)], "i int, t string")
    c = F.col("t")
    got = {r.i: r for r in df.select("i", legacy.legacy_text(c).alias("l"), legacy.structure_defects(c).alias("d"), legacy.converted(c).alias("u")).collect()}
    assert [got[i].l for i in (1, 2, 3)] == [True, False, False] and got[1].u.startswith("में है की")
    assert got[4].d == ["LEADING_SIGN", "DOUBLE_VIRAMA"] and got[5].u is None


def test_statutory(spark):
    a, b = "27ABCPE1234F1Z", "29AAACA1111A1Z"
    a, b = a + check_digit(a), b + check_digit(b)
    text = f"Sold by: Acme GSTIN {a}. Billed to: Beta GSTIN {b} and PAN ABCPE12E4F, DIN 01234567, 2O24-x"
    df = spark.createDataFrame([(1, text), (2, None), (3, a.replace("27", "Z7", 1))], "id int, text string")
    found = statutory.extract(df, "id", "text")
    got = {(r.id, r.kind, r.value) for r in found.collect()}
    assert {(1, "GSTIN", a), (1, "GSTIN", b), (1, "DIN", "01234567"), (3, "GSTIN", a)} <= got
    assert {(r.value, r.role) for r in statutory.roles(df, "id", "text", found).where("id = 1").collect()} == {(a, "supplier"), (b, "buyer")}
    assert '"GSTIN":["' + a in statutory.as_json(found, "id").where("id = 1").first().json


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 7, "view"), (2, "2024-01-01 00:50:00", 7, "error"), (2, "2024-01-01 00:50:00", 7, "error"), (3, "2024-01-01 01:10:00", 8, "view")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    path = str(tmp_path / "e")
    assert sorted(r.n for r in streams.tumbling_counts(spark, path).collect()) == [1, 1, 2]
    assert streams.distinct_events(spark, path).first().n == 3
    assert {(r.user_id, r.events, r.last_type) for r in streams.last_state(spark, path).collect()} == {(7, 3, "error"), (8, 1, "view")}
    assert streams.sessions(streams.read_events(spark, path)).isStreaming
