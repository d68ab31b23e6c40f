"""Forward-backward over linear chains, in batches bounded by cells and, for long chains, in blocks.

Scores of all words lie in one flat array, chain after chain, so that a batch is an index into it. A step between words may be
of two kinds (inside a stretch, or across the end of one), each with transitions of its own.
"""

from __future__ import annotations

import numpy as np

#: Words, padding included, that one batch holds at most.
CELLS = 200_000
#: Longer chains are run alone, block after block, with what goes from one block to the next carried over.
BLOCK = 20_000


def forward(e: np.ndarray, kinds: list[np.ndarray], cross: np.ndarray | None, alpha: np.ndarray, begun: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward scores (T, B, L) and scales (T, B); ``alpha`` is that of the word before, or the start."""
    out, scale = np.empty_like(e), np.empty(e.shape[:2])
    for i in range(len(e)):
        if i or begun:
            x = alpha @ kinds[0]
            if cross is not None and cross[i].any():
                x = np.where(cross[i][:, None], alpha @ kinds[1], x)
            x *= e[i]
        else:
            x = alpha * e[i]
        scale[i] = x.sum(axis=1)
        alpha = out[i] = x / scale[i][:, None]
    return out, scale


def backward(e: np.ndarray, kinds: list[np.ndarray], cross: np.ndarray | None, scale: np.ndarray, live: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Scaled backward scores (T, B, L), ``last`` being those of the last word; words that aren't ``live`` have 1."""
    beta = np.ones_like(e)
    beta[-1] = last
    for i in range(len(e) - 2, -1, -1):
        y = beta[i + 1] * e[i + 1]
        x = y @ kinds[0].T
        if cross is not None and cross[i + 1].any():
            x = np.where(cross[i + 1][:, None], y @ kinds[1].T, x)
        x /= scale[i + 1][:, None]
        beta[i] = np.where(live[i + 1][:, None], x, 1.0)
    return beta


def batches(lengths: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """Chains of similar length put together, with at most ``cells`` words with padding (or one chain)."""
    order = np.argsort(lengths, kind="stable")
    out, at = [], 0
    while at < len(order):
        to = at + 1
        step = 1
        # the last chain is the longest
        while to < len(order) and step:
            step = min(len(order) - to, max(1, cells // max(1, int(lengths[order[to]])) - (to - at)))
            while step and (to + step - at) * int(lengths[order[to + step - 1]]) > cells:
                step //= 2
            to += step
        out.append(order[at:to])
        at = to
    return out


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, across: np.ndarray | None = None, cross: np.ndarray | None = None, pairs: list | None = None, block: int = BLOCK) -> np.ndarray:
    """Marginals (N, L) of the words of all chains, whose log scores ``emit`` (N, L) lie one chain after the other.

    ``cross`` (N) marks words that are reached by a step of the second kind. ``pairs``, if given, gets the sums of the pair
    marginals of each kind of step.
    """
    n = emit.shape[1]
    out = np.empty_like(emit)
    kinds = [np.exp(x).astype(emit.dtype) for x in (trans, across) if x is not None]
    first = np.exp(start).astype(emit.dtype)
    offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for part in batches(lengths):
        size = int(lengths[part[-1]])
        if size == 0:
            continue
        if len(part) == 1 and size > block and pairs is None:
            _long(emit, out, int(offsets[part[0]]), size, kinds, first, cross, block)
            continue
        part = part[lengths[part] > 0]
        steps = np.arange(size)[:, None]
        live = steps < lengths[part]
        index = np.where(live, offsets[part] + steps, offsets[part])
        scores = emit[index]
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        c = cross[index] & live if cross is not None else None
        alpha, scale = forward(e, kinds, c, np.broadcast_to(first, (len(part), n)), False)
        beta = backward(e, kinds, c, scale, live, np.ones((len(part), n), e.dtype))
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        out[index[live]] = gamma[live]
        if pairs is not None and size > 1:
            w = beta[1:] * e[1:] / scale[1:, :, None] * live[1:, :, None]
            for k, a in enumerate(kinds):
                use = w if c is None else w * (c[1:] == bool(k))[:, :, None]
                pairs[k] += a * (alpha[:-1].reshape(-1, n).T @ use.reshape(-1, n))
    return out


def _long(emit: np.ndarray, out: np.ndarray, at: int, size: int, kinds: list, first: np.ndarray, cross: np.ndarray | None, block: int) -> None:
    """One chain, with the forward scores at the end of each block and the backward scores at its start carried over."""
    cuts = list(range(at, at + size, block))
    part = lambda b: slice(b, min(b + block, at + size))
    scores = lambda b: np.exp(emit[part(b)] - emit[part(b)].max(axis=1, keepdims=True))[:, None, :]
    kind = lambda b: None if cross is None else cross[part(b)][:, None]
    alphas = [first[None, :]]
    for b in cuts[:-1]:
        alphas.append(forward(scores(b), kinds, kind(b), alphas[-1], b != at)[0][-1])
    carried = np.ones((1, emit.shape[1]), emit.dtype)
    for b, before in zip(reversed(cuts), reversed(alphas)):
        e = scores(b)
        alpha, scale = forward(e, kinds, kind(b), before, b != at)
        beta = backward(e, kinds, kind(b), scale, np.ones(scale.shape, bool), carried)
        gamma = (alpha * beta)[:, 0]
        out[part(b)] = gamma / gamma.sum(axis=1, keepdims=True)
        step = kinds[1] if cross is not None and cross[b] else kinds[0]
        carried = (beta[0] * e[0]) @ step.T / scale[0][:, None]
