"""p4: the automaton against brute force, aliases, look-alikes, edge cases."""

import random

import pytest

from ledgerloom.llm.catalog import Catalogue, candidates, load, map_names, walk

ENTRIES = [
    (1, "Navtara Small Finance Bank Limited"), (2, "Navtara Payments Bank Limited"), (3, "Kaveripur Gramin Bank"), (4, "The Meghdhara Co-operative Bank Ltd."), (5, "Bank of Udayachal"), (6, "Kosalika Bank Limited"), (7, "Shubhankar Payments Bank Limited"),
]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize(
    "name,want",
    [
        ("NAVTARA SFB", 1), ("navtra small fin. bank - Lake View Br.", 1), ("Payments Bank Limited, Navtaara", 2), ("kaver ipur gramin bank", 3), ("GB, Kaveripur", 3), ("KGB", 3), ("M/s Meghdahra Sahakari Bank", 4), ("bank udayyachal", 5),
        ("Udayacha1, Bank of (Mandai)", 5), ("B.O. Udaychal", 5), ("A/c with Kosalika Bk", 6), ("शुभंकर पेमेंट्स बैंक", 7), ("Navtara Smal Finanse Bank", 1), ("Navtara Paymnts Bnk", 2), ("Kaveripur Gramen Bank", 3), ("Bnak of Udayachal", 5), ("Navtara Bank", -1), ("Navtara Housing Society", -1), ("Pomfreya Bank", -1), ("?", -1), ("generic bank", -1),
    ],
)
def test_names(name, want):
    assert Catalogue(ENTRIES).match(name) == want


def test_automaton_against_brute_force():
    rng = random.Random(5)
    c = Catalogue(ENTRIES)
    for _ in range(300):
        brand = rng.choice(list(c.kinds))
        x = list(brand)
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice("abkmrtz")
        x = "".join(x)
        found = {b for b, used, _ in c.brands(x) if used == len(x)}
        near = {b for b in c.kinds if edits(x, b) <= c.limit(len(b))}
        assert near <= found


def test_typing_errors_in_alias_paths_against_brute_force():
    rng = random.Random(6)
    c = Catalogue(ENTRIES)
    for _ in range(200):
        brand, kind, path = rng.choice([("navtara", "payments", "paymentsbank"), ("kaveripur", "gramin", "grameenbank"), ("meghdhara", "coop", "cooperativebank")])
        x = list(brand + path)
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice("abkmrtz")
        x = "".join(x)
        if edits(x, brand + path) <= 2 and edits(x[: len(brand)], brand) <= c.limit(len(brand)):
            assert (brand, kind) in {(b, k) for b, k, _ in c.whole(x, {len(x)})}, x
    assert [p for p, row in walk({"a": {"": ["hit"]}}, "b", [0, 1], 1)] == ["hit"]


def test_candidates(spark):
    df = spark.createDataFrame([(1, "Navtara Payments Bank"), (2, None), (3, "Pomfreya Bank"), (4, "Kosalika Bnk")], "detection_id long, bank_name string")
    cat = spark.createDataFrame([*ENTRIES, (10, "Navtaro Payments Bank")], "bank_id long, bank_name string")
    assert sorted(tuple(r) for r in candidates(df, cat).collect()) == [(1, 2, 0), (1, 10, 1), (4, 6, 0)]


def test_edge_cases(spark):
    rows = [(1, None, None, "z"), (2, "  ", None, "z"), (3, " ", None, "z"), (4, "Navtara SFB", None, "z"), (4, "Navtara SFB", None, "z"), (5, "x" * 20_000, None, "z")]
    df = spark.createDataFrame(rows, "detection_id long, bank_name string, ifsc string, bank_id string")
    cat = spark.createDataFrame([*ENTRIES, (9, None), (None, "X Bank"), (8, "Navtara Small Finance Bank Limited")], "bank_id long, bank_name string")
    assert sorted(tuple(r) for r in map_names(df, cat).collect()) == [(4, 1), (4, 1), (5, -1)]
    assert map_names(df.limit(0), cat).count() == 0
    assert {r.bank_id for r in map_names(df, cat.limit(0)).collect()} == {-1}
    with pytest.raises(ValueError):
        load(cat, max_entries=2)
