"""Histogram gradient-boosted trees on the driver, flattened for array traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a row goes right if its value is above
    leaf: np.ndarray       # (trees, leaves)
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        inner = self.feature.shape[1]
        depth = inner.bit_length()
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64,
          rate: float = 0.15, smoothing: float = 1.0) -> Forest:
    """Fit by logistic loss; equal gains go to the first feature and lowest bin, so reruns agree."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0)
             for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1) if width else rows
    share = (labels.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    features, thresholds = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    total = np.full(n, base)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = labels - chance, chance * (1 - chance)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            place = node - first
            best = np.full(count, 1e-9)
            for f in range(width):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                key = place * size + binned[:, f]
                g = np.bincount(key, slope, count * size).reshape(count, size).cumsum(axis=1)
                h = np.bincount(key, bend, count * size).reshape(count, size).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = (gl ** 2 / (hl + smoothing) + (gt - gl) ** 2 / (ht - hl + smoothing) - gt ** 2 / (ht + smoothing))
                cut = gain.argmax(axis=1)
                value = gain[np.arange(count), cut]
                better = value > best
                best[better] = value[better]
                features[tree, first:first + count][better] = f
                thresholds[tree, first:first + count][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (rows[np.arange(n), features[tree, node]] > thresholds[tree, node])
        end = node - inner
        step = rate * np.bincount(end, slope, leaves) / (np.bincount(end, bend, leaves) + smoothing)
        leaf[tree] = step
        total += step[end]
    return Forest(features, thresholds, leaf, base)
