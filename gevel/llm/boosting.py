"""Gradient-boosted trees for a few classes, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature, depth of a tree, rounds of one tree a class, share of each tree's step, what holds leaves small, least weight of a leaf.
BINS, DEPTH, ROUNDS, RATE, RIDGE, LEAST = 32, 5, 24, 0.3, 1.0, 4.0


@dataclass(frozen=True)
class Tree:
    """A full binary tree: at inner node k, rows whose feature is above its threshold go to 2k + 2, the others to 2k + 1."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.features[at]] > self.thresholds[at])
        return self.leaves[at - len(self.features)]


@dataclass(frozen=True)
class Model:
    first: np.ndarray
    rounds: list[list[Tree]]

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each class' share for each row."""
        out = np.tile(self.first, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += RATE * tree.values(x)
        return out - np.logaddexp.reduce(out, 1, keepdims=True)


def _grown(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> Tree:
    n, width = binned.shape
    inner = 2**DEPTH - 1
    features, thresholds = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
    at = np.zeros(n, np.int64)
    places = (np.arange(width) * BINS + binned).ravel()
    for level in range(DEPTH):
        nodes, base = 2**level, 2**level - 1
        cells = np.repeat((at - base) * width * BINS, width) + places
        g, h = (np.bincount(cells, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2) for v in (slope, curve))
        all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
        score = lambda g, h: g * g / (h + RIDGE)
        gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
        gain[(h < LEAST) | (all_h - h < LEAST)] = 0
        flat = gain.reshape(nodes, -1)
        best = flat.argmax(1)
        chosen = flat[np.arange(nodes), best] > 1e-9
        f, b = best // BINS, best % BINS
        for k in np.flatnonzero(chosen):
            features[base + k], thresholds[base + k] = f[k], cuts[f[k]][b[k]]
        # Nodes that are not split send all their rows to the left.
        k = at - base
        at = 2 * at + 1 + (chosen[k] & (binned[np.arange(n), f[k]] > b[k]))
    g, h = (np.bincount(at - inner, v, inner + 1) for v in (slope, curve))
    return Tree(features, thresholds, g / (h + RIDGE))


def fit(x: np.ndarray, classes: np.ndarray, k: int, weights: np.ndarray) -> Model:
    """Trees of a softmax model of k classes."""
    cuts = []
    for column in x.T:
        steps = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(np.concatenate([steps, np.full(BINS - len(steps), np.inf)]).astype(np.float32))
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    target = np.eye(k)[classes]
    share = (weights[:, None] * target).sum(0) + 1
    first = np.log(share / share.sum())
    out, rounds = np.tile(first, (len(x), 1)), []
    for _ in range(ROUNDS):
        p = np.exp(out - np.logaddexp.reduce(out, 1, keepdims=True))
        trees = [_grown(binned, cuts, weights * (target[:, j] - p[:, j]), weights * p[:, j] * (1 - p[:, j])) for j in range(k)]
        for j, tree in enumerate(trees):
            out[:, j] += RATE * tree.values(x)
        rounds.append(trees)
    return Model(first, rounds)
