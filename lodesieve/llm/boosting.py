"""Gradient-boosted trees in numpy: softmax loss, histogram splits, and calibration on held-out labels.

Small enough to ship to executors; fitted on a bounded sample on the driver, applied to batches of any size. Missing
values (NaN) go to the lowest bin. Ties between splits are won by the first feature and bin, so a fit is repeatable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Boosted:
    """``fit`` then ``probabilities``. Classes are 0..n-1."""

    classes: int
    rounds: int = 50
    depth: int = 4
    rate: float = 0.2
    bins: int = 48
    l2: float = 1.0
    least: float = 3.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: np.ndarray | None = None
    scale: float = 1.0
    bias: np.ndarray | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, d = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = []
        for j in range(d):
            v = x[:, j][np.isfinite(x[:, j])]
            q = np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(v) else np.zeros(0)
            if len(v):
                u = np.unique(v)
                q = (u[1:] + u[:-1]) / 2 if len(u) <= self.bins else q
            self.edges.append(q)
        b = self._binned(x)
        nb = max(len(e) for e in self.edges) + 1
        flat = b + np.arange(d)[None, :] * nb
        hot = np.eye(self.classes)[y]
        prior = (hot * w[:, None]).sum(0) + 1
        self.base = np.log(prior / prior.sum())
        z = np.tile(self.base, (n, 1))
        self.trees = []
        for _ in range(self.rounds):
            p = softmax(z)
            for c in range(self.classes):
                g, h = w * (p[:, c] - hot[:, c]), np.maximum(w * p[:, c] * (1 - p[:, c]), 1e-9)
                tree = self._grow(flat, b, g, h, nb, d)
                self.trees.append((c, *tree))
                z[:, c] += self._leaf(b, *tree)
        return self

    def _grow(self, flat: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, nb: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth + 1):
            lo, width = 2**level - 1, 2**level
            here = node >= lo
            k = node[here] - lo
            if level == self.depth or not here.any():
                G, H = np.bincount(k, g[here], width), np.bincount(k, h[here], width)
                value[lo : lo + width] = -self.rate * G / (H + self.l2)
                break
            idx = (k[:, None] * (d * nb) + flat[here]).ravel()
            G = np.bincount(idx, np.repeat(g[here], d), width * d * nb).reshape(width, d, nb)
            H = np.bincount(idx, np.repeat(h[here], d), width * d * nb).reshape(width, d, nb)
            gl, hl = G.cumsum(2), H.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
            gain = np.where((hl > self.least / 4) & (ht - hl > self.least / 4), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            good = gain[np.arange(width), best] > 1e-6
            feature[lo : lo + width] = np.where(good, best // nb, -1)
            cut[lo : lo + width] = best % nb
            value[lo : lo + width] = (-self.rate * gt / (ht + self.l2)).ravel()
            split = here.copy()
            split[here] = good[k]
            rows = np.flatnonzero(split)
            at = node[rows]
            node[rows] = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return feature, cut, value

    def _leaf(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            node = np.where(go, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((0, self.classes))
        b = self._binned(x)
        z = np.tile(self.base, (len(x), 1))
        for c, *tree in self.trees:
            z[:, c] += self._leaf(b, *tree)
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 400, prior: float = 1.0) -> Boosted:
        """Temperature and class offsets that minimise the log loss on labels not used for fitting. ``prior`` pulls them
        towards no change, so that a handful of labels changes little."""
        self.scale, self.bias = 1.0, np.zeros(self.classes)
        if not len(y):
            return self
        z, hot = self.margins(x), np.eye(self.classes)[y]
        log_scale, bias = 0.0, np.zeros(self.classes)
        for i in range(steps):
            d = (softmax(z * np.exp(log_scale) + bias) - hot) / len(y)
            step = 0.5 / (1 + i / 100)
            log_scale -= step * ((d * z).sum() * np.exp(log_scale) + prior * log_scale / len(y))
            bias -= step * (d.sum(0) + prior * bias / len(y))
            log_scale = float(np.clip(log_scale, -2.5, 1.0))
        self.scale, self.bias = float(np.exp(log_scale)), bias
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.margins(x)
        return softmax(z * self.scale + (self.bias if self.bias is not None else 0))
