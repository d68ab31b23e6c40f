"""p6: against union-find over all rows, hot groups, edge cases."""

import random

from ledgerloom.llm.copies import collapse_copies, components, find_copies

SCHEMA = "transaction_id long, account_key string, transaction_date string, description string, balance string, first_id string"


def brute(rows):
    import regex

    strip = lambda s: None if s is None else regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", s.lower())

    def segments(s):
        if s is None:
            return None
        hard = regex.compile(r"[|;/:_\-]")
        parts = hard.split(s) if hard.search(s) else regex.split(r",|\s\.\s", s)
        return tuple(sorted(x for x in (strip(p) for p in parts) if x))

    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            block = lambda r: (r[1], strip(r[2]), None if r[4] is None else regex.sub(r"[^a-z0-9.\-]", "", r[4].lower()))
            if block(a) == block(b) and (strip(a[3]) == strip(b[3]) or segments(a[3]) == segments(b[3])):
                x, y = find(a[0]), find(b[0])
                parent[max(x, y)] = min(x, y)
    return sorted((find(i), i) for i in ids if find(i) != i)


def spoil(rng, d):
    parts = d.split("|")
    if rng.random() < 0.5:
        rng.shuffle(parts)
    x = rng.choice(["|", " / ", ";", " - ", ":"]).join(rng.choice([p, p.upper(), f"({p})", p + ".", p.replace(" ", "  ")]) for p in parts)
    return x if rng.random() < 0.8 else x.replace("a", "a,", 1)


def rows_for(seed, n, hot):
    rng = random.Random(seed)
    base = [(f"acc{rng.randrange(3)}", rng.choice(["2024-01-02", "02-Jan-2024"]), rng.choice(["upi|from savings to current|ref 1", "upi|from current to savings|ref 1", "neft|abc & co|ref 22"]), rng.choice(["100.00", "-100.00", "1000.0"])) for _ in range(12)]
    out = []
    for i in range(n):
        a, d, t, b = base[0] if rng.random() < hot else rng.choice(base)
        out.append((i + 1, a, rng.choice([d, d.lower(), d.replace("-", "/")]), spoil(rng, t), rng.choice([b, " " + b]), "x"))
    return out


def test_against_brute_force(spark):
    for seed, hot in ((1, 0.0), (2, 0.6)):
        rows = rows_for(seed, 240, hot)
        got = find_copies(spark.createDataFrame(rows, SCHEMA).repartition(4))
        assert sorted(tuple(r) for r in got.collect()) == brute([r[:5] for r in rows])


def test_hot_group_over_partitions(spark):
    """A group far larger than a partition is cut and stitched."""
    df = spark.range(20_000).selectExpr("id as transaction_id", "'a' as account_key", "'2024' as transaction_date", "if(id % 2 = 0, 'UPI | x', 'x;upi') as description", "'1.0' as balance").repartition(8)
    got = find_copies(df)
    assert got.count() == 19_999 and got.where("first_id <> 0").count() == 0


def test_edge_cases(spark):
    rows = [(1, None, None, None, None, "q"), (2, None, None, None, None, "q"), (3, "", "", "", "", "q"), (4, "a", "1", "x" * 50_000, "1", "q"), (5, "a", "1", "X" * 50_000, "1", "q"), (None, "a", "1", "x", "1", "q"), (6, "a", "1", "x", "1", "q"), (6, "a", "1", "x", "1", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in find_copies(df).collect()) == [(1, 2), (4, 5)]
    assert find_copies(df.limit(0)).count() == 0
    kept = {r.transaction_id: r.n_copies for r in collapse_copies(df.where("transaction_id is not null and transaction_id <> 6")).collect()}
    assert kept == {1: 2, 3: 1, 4: 2}


def test_components_chain():
    assert components([("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")]) == [0, 0, 0, 3]
