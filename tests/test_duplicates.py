"""Duplicates against all pairs in Python, and what a first row must not hide."""

import itertools
import random

import pytest

from ledgerloom.operators import ledger

S = "id long, account string, day string, debit int, ref string, bal double, st string, sq int, text string, tm string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(rows):
    out = {}
    words = lambda t: " ".join(sorted("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()))
    for b in rows:
        proven, any_of = [], []
        for a in rows:
            if not a[0] < b[0] or a[1:4] != b[1:4]:
                continue
            ra, rb = ((x[4] or "").strip().upper() or None for x in (a, b))
            differ = lambda x, y: x is not None and y is not None and x != y
            by_ref = ra is not None and ra == rb
            if differ(ra, rb) or differ(a[5], b[5]) or differ(a[9], b[9]) or (a[6] == b[6] and a[7] != b[7] and not by_ref):
                continue
            ta, tb = words(a[8]), words(b[8])
            by_text = ta == tb
            near = not by_text and ra is None and rb is None and ta and tb and 1 - edits(ta, tb) / max(len(ta), len(tb)) >= 0.8
            proof = by_ref or (by_text and a[5] is not None and a[5] == b[5] and (a[6] != b[6] or (ra is None) != (rb is None)))
            if proof:
                proven.append(a[0])
            if by_ref or by_text or near:
                any_of.append(a[0])
        if any_of:
            out[b[0]] = (min(proven or any_of), "PROVEN" if proven else "PROBABLE")
    return out


def run(spark, rows):
    got = ledger.duplicate_transactions(spark.createDataFrame(rows, S), "id", ["account", "day", "debit"], "ref", "bal", "st", "sq", "text", "tm")
    return {r.id: (r.of_id, r.verdict) for r in got.collect()}


def test_a_contradicting_first_row_hides_nothing(spark):
    rows = [(1, "a", "d", 5, "r1", 10.0, "s1", 1, "Fee", None), (2, "a", "d", 5, "r2", 20.0, "s2", 1, "fee", None), (3, "a", "d", 5, None, 20.0, "s3", 1, "FEE.", None)]
    assert run(spark, rows) == {3: (2, "PROVEN")} == brute(rows)


def test_accounts_are_apart_and_times_contradict(spark):
    rows = [(1, "a", "d", 5, "r", None, "s1", 1, "x", None), (2, "b", "d", 5, "r", None, "s2", 1, "x", None), (3, "a", "d", 5, None, 1.0, "s3", 1, "y", "10:00"), (4, "a", "d", 5, None, 1.0, "s4", 1, "y", "11:00"), (5, "a", "d", 5, None, 1.0, "s5", 1, "y", None)]
    assert run(spark, rows) == {5: (3, "PROVEN")} == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = ["grocery store payment", "payment grocery store", "grocery stores payment", "atm", "atn", "rent for may", "", None]
    rows = [
        (i, rng.choice("ab"), "d", rng.choice([5, 6]), rng.choice([None, None, "r1", "r2", " "]), rng.choice([None, 1.0, 2.0]), rng.choice(["s1", "s2", "s3"]), rng.randrange(3), rng.choice(texts), rng.choice([None, None, "10:00", "11:00"]))
        for i in range(150)
    ]
    assert run(spark, rows) == brute(rows)


def test_hot_block_and_empty(spark):
    rows = [(i, "a", "d", 5, None, 1.0, f"s{i}", 1, "fee", None) for i in range(3000)]
    assert run(spark, rows) == {i: (0, "PROVEN") for i in range(1, 3000)}
    assert run(spark, rows[:0]) == {} and run(spark, rows[:1]) == {}


def test_long_days_chain(spark):
    rng = random.Random(1)
    rows, bal = [], 100
    for i in range(40):
        m = rng.choice([-7, 5, 11, -3])
        bal += m
        rows.append((i, m, bal))
    rng.shuffle(rows)
    df = spark.createDataFrame([("a", n, -m if m < 0 else None, m if m > 0 else None, b) for n, (i, m, b) in enumerate(rows)], "k string, seq long, debit int, credit int, bal int")
    got = {r.position: r.seq for r in ledger.intraday_reorder(df, ["k"], "seq", "debit", "credit", "bal").collect()}
    order = [rows[got[p]] for p in range(1, 41)]
    assert all(a[2] + b[1] == b[2] for a, b in itertools.pairwise(order))
    assert ledger.path_of([(1, 2), (5, 6)]) is None and ledger.path_of([(1, 2), (2, 1), (1, 3)]) == [0, 1, 2]
