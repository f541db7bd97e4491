"""Gradient-boosted trees on binned features, and calibration of their scores; numpy only."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Trees:
    """Complete binary trees of one depth: a feature and a threshold per inner node, a value per leaf."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            total += leaf[node - (2 ** self.depth - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; each level is grown from one histogram per feature and node."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1)
    total, rows = np.full(len(y), model.base), np.arange(len(y))
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = sigmoid(total)
        g, h = y - p, p * (1 - p)
        node, feature, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            best = np.full(width, 1e-9)
            local = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cells = local * bins + code[:, j]
                gs, hs = (np.bincount(cells, weights=w, minlength=width * bins).reshape(width, bins) for w in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain = gain[:, :len(e)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], feature[first:first + width][better] = top[better], j
                cut[first:first + width][better] = e[at[better]]
            node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
        gs, hs = (np.bincount(node - inner, weights=w, minlength=inner + 1) for w in (g, h))
        leaf = rate * gs / (hs + l2)
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
        total += leaf[node - inner]
    return model


@dataclass
class Calibration:
    """A rising step function from raw scores to probabilities (isotonic regression)."""

    at: np.ndarray
    share: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """The share of the last step at or below the score; 0 below the first."""
        k = np.searchsorted(self.at, raw, side="right") - 1
        return np.where(k >= 0, self.share[np.maximum(k, 0)], 0.0) if len(self.at) else np.zeros(len(raw))


def calibrate(raw: np.ndarray, y: np.ndarray, prior: float) -> Calibration:
    """Pool adjacent violators, with the classes weighted to ``prior`` positives and one false
    candidate added to every pool, so that a small pool never counts as sure."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order].astype(float)
    positive = y.sum()
    if not positive:
        return Calibration(np.empty(0), np.empty(0))
    other = max(1.0, len(y) - positive)
    weight = np.where(y > 0, prior / positive, (1 - prior) / other)
    pools: list[list[float]] = []  # score, weight of positives, weight of all
    for score, good, w in zip(raw.tolist(), y.tolist(), weight.tolist(), strict=True):
        if pools and pools[-1][0] == score:
            pools[-1][1] += good * w
            pools[-1][2] += w
        else:
            pools.append([score, good * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    one = (1 - prior) / other
    share = np.maximum.accumulate(np.array([a / (b + one) for _, a, b in pools]))
    return Calibration(np.array([p[0] for p in pools]), share)
