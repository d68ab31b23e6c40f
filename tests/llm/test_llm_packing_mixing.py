"""p8 and p9: against best fit over single items, exact shares and repeats, hot lengths, edge cases."""

import random

import pytest

from ledgerloom.llm.mixing import mix
from ledgerloom.llm.packing import pack, plan
from ledgerloom.llm.tokens import encoder, token_sizes


def best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_plan_against_single_items():
    rng = random.Random(2)
    for _ in range(40):
        capacity = rng.choice([20, 64, 100])
        sizes = [min(capacity, max(1, int(rng.expovariate(0.07)))) for _ in range(rng.randrange(1, 200))]
        hist = {s: sizes.count(s) for s in set(sizes)}
        groups = plan(hist, capacity)
        placed = {}
        for g in groups:
            assert sum(length * per for length, per, _ in g.items) == capacity - g.room >= 0
            for length, per, rank in g.items:
                for r in range(rank, rank + per * g.count):
                    assert placed.setdefault((length, r), g.first + (r - rank) // per) is not None
        assert sum(hist.values()) == len(placed) and all((s, r) in placed for s, n in hist.items() for r in range(n))
        boxes = sum(g.count for g in groups)
        assert boxes <= best_fit(sizes, capacity) * 1.06 + 1 and sorted(b for g in groups for b in range(g.first, g.first + g.count)) == list(range(boxes))


def test_pack(spark):
    word = "the account "
    rows = [(i, word * 6, "x") for i in range(300)] + [(1000 + i, word * (i % 40), "x") for i in range(80)] + [(5000, word * 900, "x"), (5001, None, "x"), (5002, "", "x"), (5003, word, "x"), (5003, word, "x"), (None, word, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container_id string")
    specs = spark.createDataFrame([(1, 64), (2, 500), (3, None), (None, 5), (4, 0)], "spec_id int, capacity_tokens int")
    got = pack(df, specs).toPandas()
    size = lambda t: len(encoder().encode_ordinary(t)) if t else 0
    total = sum(size(t) for i, t, _ in rows if i is not None)
    for spec, cap in ((1, 64), (2, 500)):
        x = got[got.spec_id == spec]
        assert x.piece_tokens.sum() == total
        by = x.groupby("container_id").agg(used=("piece_tokens", "sum"), room=("container_room", "first"), rooms=("container_room", "nunique"))
        assert ((by.used + by.room) == cap).all() and (by.rooms == 1).all()
        assert x[x.doc_id == 5000].piece_tokens.sum() == size(word * 900) and (x.groupby("doc_id").piece_tokens.agg(["sum", "size"]).query(f"sum <= {cap} and doc_id != 5003")["size"] == 1).all()
    assert set(got.spec_id) == {1, 2}
    assert pack(df.limit(0), specs).count() == 0 and pack(df, specs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, specs, max_capacity=100)


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(1, 60), rng.choice(["big"] * 8 + ["mid"] * 2 + ["small"]), None) for i in range(3000)] + [(9001, None, "big", None), (9002, "", "mid", None), (9003, "x", None, None), (9004, "y", "other", None), (None, "z", "big", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(df, targets)
    c, s = chosen.toPandas(), shares.where("source is not null").toPandas().set_index("source")
    caps = {"big": 1, "mid": 2, "small": 3}
    assert c.doc_id.is_unique and (c.repeats <= c.source.map(caps)).all() and c.doc_id.max() < 9001
    for name, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(s.actual_share[name] - want) < 0.003 and s.tokens_used[name] == (c[c.source == name].tokens * c[c.source == name].repeats).sum()
    assert s.actual_share["none"] == 0
    # nothing larger would do: some source is used up
    full = {n: df.where(f"source = '{n}' and doc_id is not null").count() for n in caps}
    assert any((c[c.source == n].repeats == caps[n]).sum() >= 0.98 * (full[n] - 1) for n in caps)
    empty, none = mix(df.limit(0), targets)
    assert empty.count() == 0 and none.where("actual_share > 0").count() == 0
    assert mix(df, targets.limit(0))[0].count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "i long, t string")
    assert {r.i: r.tokens for r in token_sizes(df, "t", ["i"]).collect()} == {1: 3, 2: 0, 3: 0}
