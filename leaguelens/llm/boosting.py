"""Small boosted trees for two classes, in numpy: second-order gains on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Each tree is (feature, cut, left, right, value) arrays over its nodes; a leaf has feature -1."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(feature)):
                f = feature[node]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, f[inner]] <= cut[at], left[at], right[at])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Trees:
    """Trees for features x (n x d) and classes y (0 or 1). Without rows, or with one class, the result is constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(binned, cuts, p - y, np.maximum(p * (1 - p), 1e-6), depth, ridge, rate)
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).margin(x)
    return model


def _tree(binned, cuts, g, h, depth, ridge, rate):
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, -1, -1, -rate * total_g / (total_h + ridge)])
        best, where = 1e-3, None
        if level < depth:
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                left_g = np.cumsum(np.bincount(binned[rows, k], g[rows], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[rows, k], h[rows], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(left_h < 0.1) | (total_h - left_h < 0.1)] = 0
                at = int(gain.argmax())
                if gain[at] > best:
                    best, where = gain[at], (k, at)
        if where:
            k, at = where
            below = binned[rows, k] <= at
            nodes[me][:2] = [k, cuts[k][at]]
            nodes[me][2] = grow(rows[below], level + 1)
            nodes[me][3] = grow(rows[~below], level + 1)
        return me

    grow(np.arange(len(g)), 0)
    f, c, left, right, v = zip(*nodes, strict=True)
    return np.array(f), np.array(c, float), np.array(left), np.array(right), np.array(v, float)
