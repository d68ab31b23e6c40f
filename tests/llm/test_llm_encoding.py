"""p2: exact round trips through every chain, decoys, edge cases."""

import pytest

from ledgerloom.llm.encoding import CHAINS, CLEAN, LOST, Detector, find_damage, garble

TEXTS = ["Veuillez déposer vos pièces à l’agence", "Für Rückfragen während der Öffnungszeiten", "आपके खाते में राशि जमा कर दी गई है।", "உங்கள் கணக்கில் தொகை", "Paid in £ and ₹ 40 – “so”"]


@pytest.mark.parametrize("chain", [c for c in CHAINS if c[0] == "utf-8"])
def test_round_trip(chain):
    d = Detector()
    for t in TEXTS:
        bad = garble(t, chain)
        found, restored, whole = d.text(bad)
        assert found and restored == t and whole, (chain, t, bad)


def test_twice_and_single_byte():
    d = Detector()
    twice = garble(garble(TEXTS[0], CHAINS[1]), CHAINS[1])
    assert d.text(twice)[1] == TEXTS[0]
    for chain in (("cp1252", "cp1251"), ("cp1252", "mac-roman")):
        found, restored, _ = d.text(garble("Votre demande a été acceptée, délai échéance prélevés", chain))
        assert found and "été acceptée" in restored


def test_lost():
    d = Detector()
    assert d.text("a �t� cr�dit�e")[0] == [LOST] and not d.text("a �t�")[2]
    for lost in ("???? ????? ???? ???.", "the ?key? and a pen", "took ?820 from you", "01.02.23 ?? ???? x", "a ?????? b"):
        assert d.text(lost)[0] == [LOST], lost
    for fine in ("Why was I charged???", "Who signed it?? Not me ???", "is it? yes", "What? 5 of them?", "x ? y : z"):
        assert d.text(fine)[0] == [], fine
    assert d.word("Br?l?")[0] == LOST and d.word("charged???")[0] == CLEAN and d.word("http://x/?a=b")[0] == CLEAN


@pytest.mark.parametrize("good", [*TEXTS, "ÀÉÎÕÜ sample of capitals", "RELEVÉ CLÔTURÉ AU GÂTEAU D’ÂGE", "SÃO TIAGO — Â/c", "БАНК № 4", "╔══ TOTAL ══╗", "Ø 40 mm ± 2 µm ©", "Zürich–Genève £ 20 ½", "Αθήνα", "why ???"])
def test_proper_text(good):
    assert Detector().text(good) == ([], good, True)


def test_edge_cases(spark):
    bad = garble(TEXTS[0], CHAINS[0])
    rows = [(1, None, "x"), (2, "", "x"), (3, bad, "x"), (3, bad, "x"), (None, bad, "x"), (4, ("plain " * 40_000) + bad, "x"), (5, "plain", "x")]
    df = spark.createDataFrame(rows, "id long, text string, restored string")
    got = find_damage(df, "id", "text").collect()
    assert sorted(r.id for r in got) == [3, 3, 4] and all(r.restorable for r in got) and got[0].restored.startswith("Veuillez") | got[0].restored.startswith("plain")
    assert find_damage(df.limit(0), "id", "text").count() == 0
