"""A maximum-entropy (logistic) classifier over hashed string features, fitted with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 16


class MaxEnt:
    """Binary classifier. Every example has the same number of features, each a string."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @staticmethod
    def index(features: tuple[str, ...]) -> list[int]:
        return [xxhash.xxh32_intdigest(f"{k}\t{f}") & ((1 << BITS) - 1) for k, f in enumerate(features)]

    @classmethod
    def fit(cls, rows: list[tuple[str, ...]], labels: list[int], rounds: int = 30, rate: float = 0.4, decay: float = 1e-5, seed: int = 0) -> MaxEnt:
        """AdaGrad over mini-batches of the penalised log-likelihood."""
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
        if not rows:
            return cls(w)
        x = np.array([cls.index(r) for r in rows])
        y = np.array(labels, dtype=float)
        share = {c: max(1, int((y == c).sum())) for c in (0, 1)}
        weight = np.where(y == 1, len(y) / 2 / share[1], len(y) / 2 / share[0])
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for a in range(0, len(y), 256):
                i = order[a : a + 256]
                p = 1 / (1 + np.exp(-np.clip(w[x[i]].sum(axis=1), -30, 30)))
                err = (p - y[i]) * weight[i] / len(i)
                g = np.bincount(x[i].ravel(), np.repeat(err, x.shape[1]), minlength=len(w)) + decay * w
                g2 += g * g
                w -= rate * g / np.sqrt(g2) * (g != 0)
        return cls(w)

    def score(self, features: tuple[str, ...]) -> float:
        """Log-odds."""
        return float(self.weights[self.index(features)].sum())
