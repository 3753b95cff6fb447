"""Gradient-boosted regression trees for two classes, on binned features, with numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Sum of complete binary trees of one depth; a leaf adds to the log-odds."""

    def __init__(self, edges: list[np.ndarray], prior: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int):
        self.edges, self.prior, self.trees, self.depth = edges, prior, trees, depth

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.3, least: float = 8.0, ridge: float = 1.0) -> Boosted:
        """Newton boosting of the logistic loss; splits by histogram."""
        edges = []
        for j in range(x.shape[1]):
            v = np.unique(x[:, j])
            edges.append(np.unique(np.quantile(v, np.linspace(0, 1, BINS)[1:-1])) if len(v) > BINS else (v[1:] + v[:-1]) / 2)
        b = cls._bin(x, edges)
        n, k = b.shape
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        prior = float(np.log(share / (1 - share)))
        score = np.full(n, prior)
        flat = b.astype(np.int64) + np.arange(k) * BINS
        out = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255, dtype=np.int64)
            for level in range(depth):
                wide = 2**level
                at = (node[:, None] * (k * BINS) + flat).ravel()
                G = np.bincount(at, np.repeat(g, k), minlength=wide * k * BINS).reshape(wide, k, BINS).cumsum(axis=2)
                H = np.bincount(at, np.repeat(h, k), minlength=wide * k * BINS).reshape(wide, k, BINS).cumsum(axis=2)
                gt, ht = G[:, :, -1:], H[:, :, -1:]
                gain = G**2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt**2 / (ht + ridge)
                gain[(H < least * 0.1) | (ht - H < least * 0.1)] = -1
                best = gain.reshape(wide, -1).argmax(axis=1)
                ok = gain.reshape(wide, -1).max(axis=1) > 1e-3
                base = wide - 1
                feature[base : base + wide] = best // BINS
                cut[base : base + wide] = np.where(ok, best % BINS, 255)
                f, c = feature[base + node], cut[base + node]
                node = 2 * node + (b[np.arange(n), f] > c)
            leaf_g = np.bincount(node, g, minlength=2**depth)
            leaf_h = np.bincount(node, h, minlength=2**depth)
            leaf = -rate * leaf_g / (leaf_h + ridge)
            score += leaf[node]
            out.append((feature, cut, leaf))
        return cls(edges, prior, out, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        if not len(x):
            return np.zeros(0)
        # only columns that a tree compares; a few edges are counted, many are searched
        b = np.zeros((x.shape[1], len(x)), dtype=np.uint8)
        for j in {int(f) for feature, cut, _ in self.trees for f, c in zip(feature, cut, strict=True) if c != 255}:
            v, e = np.ascontiguousarray(x[:, j]), self.edges[j]
            if len(e) > 4:
                b[j] = np.searchsorted(e, v, side="right")
            else:
                for edge in e:
                    b[j] += v >= edge
        total = np.full(len(x), self.prior)
        for feature, cut, leaf in self.trees:
            # which leaf, from the bottom up: every node is a comparison of one column, and picks one of two leaf numbers bit by bit
            at: list[np.ndarray | int] = list(range(len(leaf)))
            for level in range(self.depth - 1, -1, -1):
                base = 2**level - 1
                at = [self._pick(b, int(feature[base + k]), int(cut[base + k]), at[2 * k], at[2 * k + 1]) for k in range(2**level)]
            total += leaf[at[0]]
        return total

    @staticmethod
    def _pick(b: np.ndarray, feature: int, cut: int, low: np.ndarray | int, high: np.ndarray | int) -> np.ndarray | int:
        if cut == 255:
            return low
        right = (b[feature] > cut).view(np.uint8) * np.uint8(255)
        return np.bitwise_xor(low, np.bitwise_and(np.bitwise_xor(low, high, dtype=np.uint8), right), dtype=np.uint8)
