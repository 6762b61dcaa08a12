"""Small learners in numpy: binning, boosted lookup tables, boosted trees, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner quantile borders of each column, at most ``bins`` - 1."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1) if x.size else np.zeros(x.shape, np.int64)


def shallow(g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float = 1.0) -> np.ndarray:
    """Leaf value of each bin, by a tree of ``depth`` over bins in order: g and h are sums of gradients and curvatures."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge), -np.inf)
    k = int(np.argmax(gain))
    if gain[k] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate((shallow(g[: k + 1], h[: k + 1], depth - 1, least, ridge), shallow(g[k + 1 :], h[k + 1 :], depth - 1, least, ridge)))


@dataclass
class PairwiseAdditive:
    """Generalised additive model with pairwise interactions: lookup tables over bins, added up and squashed."""

    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.12, depth: int = 2, least: float = 2.0) -> PairwiseAdditive:
        """Cyclic boosting: each round visits each feature in turn and adds a shallow tree's leaves to its table."""
        if not len(y) or y.min() == y.max():
            p = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
            return cls(base=float(np.log(p / (1 - p))))
        m = cls(cut_points(x, bins), cut_points(x, coarse_bins), float(np.log(y.mean() / (1 - y.mean()))))
        b = binned(x, m.cuts)
        m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
        f = np.full(len(y), m.base)
        for _ in range(rounds):
            for k, t in enumerate(m.tables):
                p = sigmoid(f)
                step = rate * shallow(np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t)), depth, least)
                t += step
                f += step[b[:, k]]
        c = binned(x, m.coarse)
        size = [len(v) + 1 for v in m.coarse]
        p = sigmoid(f)

        def cells(i: int, j: int, w: np.ndarray) -> np.ndarray:
            return np.bincount(c[:, i] * size[j] + c[:, j], w, size[i] * size[j]).reshape(size[i], size[j])

        def strength(i: int, j: int) -> float:
            """Best gain of one cut in each feature: four quadrants."""
            g, h = cells(i, j, y - p).cumsum(0).cumsum(1), cells(i, j, p * (1 - p)).cumsum(0).cumsum(1)
            parts = [(s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1]) for s in (g, h)]
            return float(max((sum(a**2 / (v + 1) for a, v in zip(*parts, strict=True))).max(), 0)) if min(size[i], size[j]) > 1 else 0.0

        ranked = sorted(((strength(i, j), i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
        m.pairs = [(i, j, np.zeros((size[i], size[j]))) for s, i, j in ranked[:n_pairs] if s > 0]
        for _ in range(pair_rounds):
            for i, j, t in m.pairs:
                p = sigmoid(f)
                g, h = cells(i, j, y - p), cells(i, j, p * (1 - p))
                rows = shallow(g.sum(1), h.sum(1), 1, least)  # one cut along i, then one along j on each side
                step = np.empty_like(t)
                for value in np.unique(rows):
                    side = rows == value
                    step[side] = rate * shallow(g[side].sum(0), h[side].sum(0), 1, least)
                t += step
                f += step[c[:, i], c[:, j]]
        return m

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.tables:
            b, c = binned(x, self.cuts), binned(x, self.coarse)
            for k, t in enumerate(self.tables):
                f += t[b[:, k]]
            for i, j, t in self.pairs:
                f += t[c[:, i], c[:, j]]
        return sigmoid(f)


@dataclass
class BoostedTrees:
    """Gradient-boosted trees of a fixed depth for the logistic loss, over binned features."""

    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature and bin of each inner node, leaf values
    depth: int = 3

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 80, rate: float = 0.15, depth: int = 3, least: float = 2.0, ridge: float = 1.0) -> BoostedTrees:
        if not len(y) or y.min() == y.max():
            p = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
            return cls(base=float(np.log(p / (1 - p))))
        m = cls(cut_points(x, bins), float(np.log(y.mean() / (1 - y.mean()))), depth=depth)
        b = binned(x, m.cuts)
        f = np.full(len(y), m.base)
        width = max(len(c) for c in m.cuts) + 1
        for _ in range(rounds):
            p = sigmoid(f)
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, border = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width, np.int64)
            for level in range(depth):
                first, n = (1 << level) - 1, 1 << level
                best = np.full(n, 1e-9)
                for k in range(x.shape[1]):
                    key = (node - first) * width + b[:, k]
                    gs, hs = (np.bincount(key, w, n * width).reshape(n, width) for w in (g, h))
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = np.where((hl >= least) & (ht - hl >= least), gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge), -1)
                    at = gain.argmax(1)
                    top = gain[np.arange(n), at]
                    for q in np.nonzero(top > best)[0]:
                        best[q], feature[first + q], border[first + q] = top[q], k, at[q]
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > border[node])
            leaf = node - ((1 << depth) - 1)
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            m.trees.append((feature, border, value))
            f += value[leaf]
        return m

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        f = np.full(len(x), self.base)
        if self.trees:
            b, each = binned(x, self.cuts), np.arange(len(x))
            for feature, border, value in self.trees:
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (b[each, feature[node]] > border[node])
                f += value[node - ((1 << self.depth) - 1)]
        return f


@dataclass
class Isotonic:
    """Non-decreasing step map from log-odds by pooling adjacent violators, linear between its steps.

    A pool of few rows says little, so each pool is drawn to the scores' own probability with the weight of ``prior`` rows.
    """

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, score: np.ndarray, y: np.ndarray, prior: float = 10.0) -> Isotonic:
        if not len(y):
            return cls(np.zeros(1), np.full(1, 0.5))
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum, count, first score, last score
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1, s, s])
            while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
        xs = [q for b in blocks for q in (b[2], b[3])]
        ys = [(b[0] + prior * own) / (b[1] + prior) for b in blocks for own in sigmoid(np.array(b[2:])).tolist()]
        return cls(np.array(xs), np.maximum.accumulate(ys))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
