"""Gradient-boosted trees on quantile histograms: several classes, softmax loss, temperature-calibrated. Plain numpy.

Training data is a bounded sample on the driver; prediction is vectorised and runs inside Arrow batches of the executors.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``rounds`` trees per class of at most ``depth`` levels; ``temperature`` is set by ``calibrate``."""

    def __init__(self, classes: int, rounds: int = 24, depth: int = 3, rate: float = 0.35, bins: int = 32, least: float = 5.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least = classes, rounds, depth, rate, bins, least
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        half = np.linspace(0, 1, self.bins // 2 + 1)[:-1]  # of the rows, and of the distinct values, for rare large ones
        self.edges = [np.unique(np.concatenate([np.quantile(x[:, j], half), np.quantile(np.unique(x[:, j]), half)])) for j in range(f)]
        codes = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(f)], 1).astype(np.int32)
        target = np.eye(self.classes)[y]
        weight = (n / (self.classes * np.maximum(target.sum(0), 1)))[y] ** 0.5
        score = np.zeros((n, self.classes))
        for _ in range(self.rounds):
            p = _softmax(score)
            trees = []
            for k in range(self.classes):
                g, h = weight * (target[:, k] - p[:, k]), weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                feature, cut, value, leaf = self._tree(codes, g, h)
                score[:, k] += value[leaf]
                trees.append((feature, np.array([self.edges[j][c] if j >= 0 and c < len(self.edges[j]) else np.inf for j, c in zip(feature, cut)]), value))
            self.trees.append(trees)
        return self

    def _tree(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Complete binary tree in heap order: at node i rows with code <= cut go to 2i + 1; unsplit nodes send all there."""
        n, f = codes.shape
        inner = 2**self.depth - 1
        feature, cut = np.full(inner, -1), np.zeros(inner, int)
        node = np.zeros(n, int)
        bins = self.bins + 2
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(at, g, width), np.bincount(at, h, width)
            for j in range(f):
                key = at * bins + codes[:, j]
                left_g = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                left_h = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                gain[(left_h < self.least * 0.1) | (right_h < self.least * 0.1)] = 0
                c = gain.argmax(1)
                top = gain[np.arange(width), c]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = c[better]
            j = feature[node]
            right = (j >= 0) & (codes[np.arange(n), np.maximum(j, 0)] > cut[node])
            node = 2 * node + 1 + right
        leaf = node - inner
        size = 2**self.depth
        value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
        return feature, cut, value, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        columns = np.asfortranarray(x)

        def leaf_value(feature, cut, value, node: int):
            if node >= len(feature):
                return value[node - len(feature)]
            if feature[node] < 0:  # unsplit: every row goes to the first child
                return leaf_value(feature, cut, value, 2 * node + 1)
            low, high = (leaf_value(feature, cut, value, 2 * node + i) for i in (1, 2))
            return np.where(columns[:, feature[node]] > cut[node], high, low)

        for trees in self.trees:
            for k, (feature, cut, value) in enumerate(trees):
                out[:, k] += leaf_value(feature, cut, value, 0)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Temperature that minimises the log loss on a holdout the trees haven't seen."""
        s = self.scores(x)
        grid = np.exp(np.linspace(-1.5, 2.0, 60))
        self.temperature = float(min(grid, key=lambda t: -np.log(_softmax(s / t)[np.arange(len(y)), y] + 1e-12).mean()))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) / self.temperature) if len(x) else np.zeros((0, self.classes))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
