"""Forward-backward against enumeration, with two kinds of steps, padding and blocks."""

import itertools

import numpy as np

from ledgerloom.llm.chains import batches, marginals


def brute(emit, trans, start, across, cross):
    t, n = emit.shape
    want, total, pairs = np.zeros((t, n)), 0.0, [np.zeros((n, n)), np.zeros((n, n))]
    for path in itertools.product(range(n), repeat=t):
        p = start[path[0]] + sum(emit[i, y] for i, y in enumerate(path))
        p = np.exp(p + sum((across if cross[i] else trans)[path[i - 1], path[i]] for i in range(1, t)))
        total += p
        for i, y in enumerate(path):
            want[i, y] += p
            if i:
                pairs[int(cross[i])][path[i - 1], y] += p
    return want / total, [x / total for x in pairs]


def test_against_enumeration():
    rng = np.random.default_rng(0)
    n, lengths = 3, np.array([4, 1, 5, 2])
    emit, trans, across, start = rng.normal(size=(lengths.sum(), n)), rng.normal(size=(n, n)), rng.normal(size=(n, n)), rng.normal(size=n)
    cross = rng.random(lengths.sum()) < 0.4
    pairs = [np.zeros((n, n)), np.zeros((n, n))]
    got = marginals(emit, lengths, trans, start, across, cross, pairs)
    at, all_pairs = 0, [np.zeros((n, n)), np.zeros((n, n))]
    for size in lengths:
        want, p = brute(emit[at : at + size], trans, start, across, cross[at : at + size])
        assert np.allclose(got[at : at + size], want)
        all_pairs = [x + y for x, y in zip(all_pairs, p)]
        at += size
    assert np.allclose(pairs, all_pairs)


def test_blocks_give_the_same():
    rng = np.random.default_rng(1)
    n, lengths = 4, np.array([97, 3])
    emit, trans, across, start = rng.normal(size=(100, n)), rng.normal(size=(n, n)), rng.normal(size=(n, n)), rng.normal(size=n)
    cross = rng.random(100) < 0.2
    whole = marginals(emit, lengths, trans, start, across, cross)
    for block in (10, 32, 96):
        # alone in its batch, the long chain is run in blocks
        assert np.allclose(marginals(emit[:97], lengths[:1], trans, start, across, cross[:97], block=block), whole[:97])


def test_batches_are_bounded():
    lengths = np.array([1] * 5000 + [3, 800, 5, 100_000, 70, 0])
    got = batches(lengths, 2000)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= 2000 for b in got) and len(got) < 12
