"""Fitting and decoding of linear-chain conditional random fields with sparse features."""

from __future__ import annotations

import numpy as np


def scores(weights: np.ndarray, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """(item, label) sums of the weights of every item's features."""
    found = weights[ids]
    return np.stack(
        [np.bincount(rows, found[:, k], minlength=n) for k in range(weights.shape[1])], axis=1
    )


def fit(
    rows: np.ndarray,
    ids: np.ndarray,
    items: int,
    table: int,
    chains: np.ndarray,
    labels: np.ndarray,
    count: int,
    iterations: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions (from, to) that make `labels` of
    `chains` (chain, place), which hold item numbers, likely. Items have the
    (row, feature) pairs `rows`, `ids`. The first place follows any label.

    Gradient ascent with adaptive steps over all chains at once.
    """
    gold = np.eye(count)[labels]
    spot = (chains[..., None] * count + np.arange(count)).ravel()

    def by_item(mass: np.ndarray) -> np.ndarray:
        return np.bincount(spot, mass.ravel(), items * count).reshape(-1, count)

    known = by_item(gold)
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    weights, moves = np.zeros((table, count)), np.zeros((count, count))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    scale, length = 1.0 / chains.size, chains.shape[1]
    for step in range(1, iterations + 1):
        item = scores(weights, rows, ids, items)
        emit = np.exp(item - item.max(axis=1, keepdims=True))[chains]
        move = np.exp(moves)
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        before = np.ones((len(chains), count))
        for t in range(length):
            before = (before @ move) * emit[:, t]
            before /= before.sum(axis=1, keepdims=True)
            alpha[:, t] = before
        expected_pairs = np.zeros_like(moves)
        for t in range(length - 2, -1, -1):
            after = emit[:, t + 1] * beta[:, t + 1]
            joint = alpha[:, t, :, None] * move * after[:, None, :]
            expected_pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[:, t] = after @ move.T
            beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        gap = (known - by_item(post))[rows] * scale
        push = np.stack([np.bincount(ids, gap[:, k], table) for k in range(count)], axis=1)
        slopes = (push - 1e-7 * weights, (pairs - expected_pairs) * scale - 1e-5 * moves)
        for value, slope, (first, second) in zip((weights, moves), slopes, state):
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            value += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def viterbi(item: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label of every item: chains stand one after the other in `item`
    (item, label), from `starts` on; none is empty. Ties go to the smaller label."""
    n, count = item.shape
    sizes = np.diff(np.append(starts, n))
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)]
    back = np.zeros((n, count), dtype=np.int8)
    best = np.zeros((len(starts), count))
    for t in range(steps):
        m = active[t]
        at = first[:m] + t
        paths = best[:m, :, None] + moves
        if t:
            back[at] = paths.argmax(axis=1)
            best[:m] = paths.max(axis=1) + item[at]
        else:
            best[:m] = np.log(np.exp(moves).sum(axis=0)) + item[at]
    out = np.zeros(n, dtype=np.int64)
    label = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return out
