"""Gradient-boosted trees for a binary label, fitted on quantile bins with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth: split features, thresholds and leaf values by heap position."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss; ties go to the first feature and bin, so refits agree."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    # All features' bins side by side: one histogram a level, and sums to the left of every cut by one running sum.
    sizes = np.array([len(c) + 1 for c in cuts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    cells = (binned + begin[:-1]).astype(np.int64)
    total = int(begin[-1])
    feature_of = np.repeat(np.arange(width), sizes)
    is_cut = np.arange(total) != begin[1:][feature_of] - 1
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        wide_g, wide_h = np.repeat(g, width), np.repeat(h, width)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            start, size = 2**level - 1, 2**level
            cell = ((at - start) * total)[:, None] + cells
            left = []
            for wide in (wide_g, wide_h):
                run = np.bincount(cell.ravel(), wide, size * total).reshape(size, total).cumsum(axis=1)
                run = np.concatenate([np.zeros((size, 1)), run], axis=1)
                left.append((run[:, 1:] - run[:, begin[feature_of]], run[:, begin[1]][:, None]))
            (gl, ga), (hl, ha) = left
            gr, hr = ga - gl, ha - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - ga**2 / (ha + ridge)
            gain[(hl < least) | (hr < least) | ~is_cut] = 0
            best = np.round(gain, 9).argmax(axis=1)
            for s in np.flatnonzero(gain[np.arange(size), best] > 1e-6):
                j = feature_of[best[s]]
                f[start + s], t[start + s] = j, cuts[j][best[s] - begin[j]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        all_f.append(f)
        all_t.append(t)
        all_v.append(value)
    return Boosted(base, np.array(all_f), np.array(all_t), np.array(all_v))
