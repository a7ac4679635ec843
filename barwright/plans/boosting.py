"""Boosted trees of depth two over binned features, small enough for one symbol's history in a task."""

from __future__ import annotations

import numpy as np

BINS, LEAST_ROWS, LEAST_HESSIAN = 64, 20, 1e-3


def cuts_of(x: np.ndarray) -> np.ndarray:
    """Between distinct values if those are few, else at quantiles."""
    v = np.unique(x)
    if len(v) > BINS:
        v = np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]))
        return v
    return (v[:-1] + v[1:]) / 2


class Boosted:
    """Log-loss boosting: each tree is grown on histograms of gradients and hessians, split twice, and shrunk."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 120, rate: float = 0.05):
        n, f = x.shape
        self.cuts = [cuts_of(x[:, k]) for k in range(f)]
        code = self._codes(x)
        flat = code + np.arange(f) * BINS
        share = y.mean()
        self.base, self.trees = float(np.log(share / (1 - share))), []
        score = np.full(n, self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            root = self._sums(flat, g, h)
            first = self._best(root)
            if first is None:
                break
            left = code[:, first[0]] <= first[1]
            small = left if left.sum() * 2 <= n else ~left
            part = self._sums(flat[small], g[small], h[small])
            parts = (part, root - part) if small is left else (root - part, part)
            tree, add = [first], np.zeros(n)
            for rows, sums in ((left, parts[0]), (~left, parts[1])):
                split = self._best(sums)
                total = sums[:, :BINS].sum(axis=1)
                values = [-rate * total[0] / total[1]] * 2
                if split is not None:
                    low = sums[:, split[0] * BINS : split[0] * BINS + split[1] + 1].sum(axis=1)
                    values = [-rate * s[0] / s[1] for s in (low, total - low)]
                    add[rows] = np.where(code[rows, split[0]] <= split[1], *values)
                else:
                    add[rows] = values[0]
                tree.append((*(split or (0, BINS)), *values))
            self.trees.append(tree)
            score += add

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1)

    @staticmethod
    def _sums(flat: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Gradients, hessians and rows of each bin of each feature."""
        at, f, size = flat.ravel(), flat.shape[1], flat.shape[1] * BINS
        return np.stack([np.bincount(at, np.repeat(g, f), size), np.bincount(at, np.repeat(h, f), size), np.bincount(at, minlength=size).astype(float)])

    @staticmethod
    def _best(sums: np.ndarray) -> tuple[int, int] | None:
        """Feature and last bin of the left side with the largest gain, the first of equal ones; None without a gain."""
        left = sums.reshape(3, -1, BINS).cumsum(axis=2)
        total = left[:, :, -1:]
        right = total - left
        fit = (left[2] >= LEAST_ROWS) & (right[2] >= LEAST_ROWS) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fit, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], 0)
        at = int(gain.argmax())
        return divmod(at, BINS) if gain.flat[at] > 1e-10 else None

    def probability(self, x: np.ndarray) -> np.ndarray:
        code, score = self._codes(x), np.full(len(x), self.base)
        for (f, b), *sides in self.trees:
            left = code[:, f] <= b
            for rows, (k, c, low, high) in ((left, sides[0]), (~left, sides[1])):
                score[rows] += np.where(code[rows, k] <= c, low, high)
        return 1 / (1 + np.exp(-score))


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Share of (1, 0) pairs in order, ties half, by ranks."""
    _, at, many = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(many) - (many - 1) / 2)[at]
    ones = label == 1
    a, b = int(ones.sum()), int((~ones).sum())
    return float((rank[ones].sum() - a * (a + 1) / 2) / (a * b))


def blocks(n: int, folds: int) -> list[tuple[int, int]]:
    """First row and end of each later block of time; all rows before it come before it."""
    size = n // (folds + 1)
    return [(n - (folds - k) * size, n - (folds - k - 1) * size) for k in range(folds)] if size else []
