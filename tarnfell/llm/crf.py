"""Linear-chain conditional random field with two labels, trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Field:
    """Weights: by feature and label, and by pair of neighbouring labels."""

    weights: dict[str, tuple[float, float]]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, rows: list[list[str]]) -> list[int]:
        """Likeliest labels of a chain (Viterbi); features that training never saw count nothing."""
        if not rows:
            return []
        (s00, s01), (s10, s11) = self.steps
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        for i, row in enumerate(rows):
            e0 = e1 = 0.0
            for name in row:
                if name in self.weights:
                    w = self.weights[name]
                    e0 += w[0]
                    e1 += w[1]
            if i == 0:
                zero, one = e0, e1
                continue
            back.append((int(one + s10 > zero + s00), int(one + s11 > zero + s01)))
            zero, one = max(zero + s00, one + s10) + e0, max(zero + s01, one + s11) + e1
        label = int(one > zero)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _both(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(a, axis=axis)


def train(chains: list[tuple[list[list[str]], list[int]]], rounds: int = 200, rate: float = 0.5, damping: float = 1e-4) -> Field:
    """Fit by gradient ascent on the likelihood of whole chains (forward-backward, all chains side by side)."""
    names = sorted({f for rows, _ in chains for row in rows for f in row})
    index = {f: i for i, f in enumerate(names)}
    longest = max((len(rows) for rows, _ in chains), default=0)
    count = len(chains)
    cell, feature = [], []
    truth, real = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for c, (rows, labels) in enumerate(chains):
        real[c, :len(rows)] = True
        truth[c, :len(rows)] = labels
        for i, row in enumerate(rows):
            cell += [c * longest + i] * len(row)
            feature += [index[f] for f in row]
    cell, feature = np.array(cell, np.int64), np.array(feature, np.int64)
    weights, steps = np.zeros((len(names), 2)), np.zeros((2, 2))
    seen_w, seen_s = np.full(weights.shape, 1e-6), np.full(steps.shape, 1e-6)
    right = np.eye(2)[truth] * real[..., None]
    inner = real[:, 1:, None, None]
    pairs = (np.eye(2)[truth[:, :-1]][..., :, None] * np.eye(2)[truth[:, 1:]][..., None, :] * inner).sum(axis=(0, 1))
    for _ in range(rounds):
        emit = np.stack([np.bincount(cell, weights[feature, k], count * longest) for k in (0, 1)], axis=1).reshape(count, longest, 2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for i in range(1, longest):
            ahead[:, i] = np.where(real[:, i, None], emit[:, i] + _both(ahead[:, i - 1, :, None] + steps, 1), ahead[:, i - 1])
        for i in range(longest - 2, -1, -1):
            behind[:, i] = np.where(real[:, i + 1, None], _both(steps + (emit + behind)[:, i + 1, None, :], 2), 0)
        total = _both(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - total[:, None, None]) * real[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + steps + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * inner
        error = (right - chance).reshape(-1, 2)
        slope = np.stack([np.bincount(feature, error[cell, k], len(names)) for k in (0, 1)], axis=1) - damping * weights * count
        bend = pairs - joint.sum(axis=(0, 1)) - damping * steps * count
        seen_w += slope ** 2
        seen_s += bend ** 2
        weights += rate * slope / np.sqrt(seen_w)
        steps += rate * bend / np.sqrt(seen_s)
    return Field({f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in index.items()}, tuple(map(tuple, steps.tolist())))
