"""p10: held-out accuracy on made-up levels, edge cases."""

import random

from ledgerloom.llm.reading import BANDS, Levels, assign_levels, grade

STYLES = {
    1: ["The dog ran home.", "It is hot in here.", "Mum made a big cake for us.", "We sat on the mat.", "Put the cup on the shelf."],
    2: ["The gardener planted three rows of onions before the rain began to fall.", "My sister walks to the library every week and brings back a story about animals."],
    3: ["The municipal council postponed its decision regarding the proposed swimming facility until additional information became available.", "Several residents expressed considerable dissatisfaction concerning the unreliable transportation arrangements."],
    4: ["Insofar as the appellant's multifarious contentions presuppose retrospective applicability of the aforementioned constitutional provisions, their irreconcilability with established jurisprudential interpretation necessitates unequivocal repudiation, notwithstanding considerable countervailing humanitarian considerations."],
}


def text(rng, level):
    out = []
    while sum(len(x.split()) for x in out) < 70:
        out.append(rng.choice(STYLES[level]))
    return " ".join(out)


def test_held_out():
    rng = random.Random(1)
    m = Levels([(text(rng, k), k) for k in STYLES for _ in range(10)], (1, 2, 3, 4))
    assert all(m.level(text(rng, k))[0] == k for k in STYLES for _ in range(5))
    assert abs(m.posterior("zzz qqq").sum() - 1) < 1e-9


def test_query(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, 1 + i % 4), "q") for i in range(40)]
    labels = [(i, 1 + i % 4) for i in range(20)] + [(3, 4), (999, 1), (5, None), (6, 9)]
    extra = [(100, None, "q"), (101, "", "q"), (102, "too short", "q"), (103, "आपके खाते में राशि जमा कर दी गई है। " * 20, "q"), (None, rows[0][1], "q"), (104, rows[0][1] + " " + "Les voisins de mon oncle ont acheté une vieille maison.", "q"), (105, rows[2][1] * 400, "q")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, level string")
    lab = spark.createDataFrame(labels, "doc_id long, level int")
    got = {r.id: r.level for r in assign_levels(df, lab).collect()}
    assert {i: got[i] for i in range(40)} == {i: 1 + i % 4 for i in range(40)}
    assert set(got) == set(range(40)) | {105}
    assert assign_levels(df.limit(0), lab).count() == 0
    # without labels all levels are seeded by the formula, and the hard texts stay above the easy ones
    seeded = {r.id: r.level for r in assign_levels(df, lab.limit(0)).collect()}
    assert set(seeded) == set(got) and max(seeded[i] for i in range(0, 40, 4)) < min(seeded[i] for i in range(3, 40, 4))


def test_missing_level_is_seeded(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, text(rng, 1 + i % 4)) for i in range(40)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1 + i % 4) for i in range(40) if i % 4 != 3], "doc_id long, level int")
    got = {r.id: r.level for r in assign_levels(df, lab).collect()}
    assert got == {i: 1 + i % 4 for i in range(40)}
    assert grade(text(rng, 1)) < BANDS[0] and grade(text(rng, 4)) > BANDS[2]


def test_marks_are_an_addition():
    rng = random.Random(3)
    plain = Levels([(text(rng, k), k) for k in STYLES for _ in range(10)], (1, 2, 3, 4), marks=False)
    assert all(plain.level(text(rng, k))[0] == k for k in STYLES for _ in range(5)) and not any(w.startswith("<") for w in plain.vocabulary)
