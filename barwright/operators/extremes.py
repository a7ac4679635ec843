"""Searches along a row of bars in steps of 1, 2, 4 ... bars, for many starts at once."""

from __future__ import annotations

import numpy as np


class Extremes:
    """Highest high, lowest low and deepest fall (from a high to a later low) of each stretch of 1, 2, 4 ... bars, up to ``longest``.

    A search from a start steps over the longest stretch that surely holds no
    hit, then over shorter ones, so it costs the logarithm of the way.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, longest: int):
        self.n, self.high, self.low = len(high), [high], [low]
        self.fall = [np.full(len(high), -np.inf)]
        half = 1
        while 2 * half <= min(self.n, longest):
            h, lo, f = self.high[-1], self.low[-1], self.fall[-1]
            self.fall.append(np.maximum(np.maximum(f[:-half], f[half:]), h[:-half] - lo[half:]))
            self.high.append(np.maximum(h[:-half], h[half:]))
            self.low.append(np.minimum(lo[:-half], lo[half:]))
            half *= 2

    def _walk(self, at: np.ndarray, end: np.ndarray, clear, took=None) -> np.ndarray:
        """Goes on from ``at`` while ``clear(level, rows, places)`` holds; ``end`` where it holds all the way."""
        at = at.copy()
        rows = np.flatnonzero(at < end)
        while len(rows):
            for level in reversed(range(len(self.high))):
                fit = rows[at[rows] + (1 << level) <= end[rows]]
                go = fit[clear(level, fit, at[fit])]
                if took is not None:
                    took(level, go, at[go])
                at[go] += 1 << level
            # What stands at a bar without a hit has met a stretch that might have had one; it goes on from there.
            rows = rows[at[rows] < end[rows]]
            rows = rows[clear(0, rows, at[rows])]
        return at

    def first_low(self, at: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """First bar from ``at`` on, before ``end``, whose low is at or under ``bound``; ``end`` without one."""
        return self._walk(at, end, lambda k, r, p: self.low[k][p] > bound[r])

    def first_high(self, at: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return self._walk(at, end, lambda k, r, p: self.high[k][p] < bound[r])

    def first_under_trail(self, at: np.ndarray, end: np.ndarray, floor: np.ndarray, best: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bar whose low is at or under ``floor`` or under the best price before it (``best`` or a later high) less ``gap``; and that best price."""
        best = best.copy()

        def clear(k: int, r: np.ndarray, p: np.ndarray) -> np.ndarray:
            low, spare = self.low[k][p], 1e-9 * (np.abs(gap[r]) + np.abs(self.high[k][p]))
            return (low > floor[r]) & (low > best[r] - gap[r]) & (self.fall[k][p] < gap[r] - spare)

        def took(k: int, r: np.ndarray, p: np.ndarray) -> None:
            best[r] = np.maximum(best[r], self.high[k][p])

        return self._walk(at, end, clear, took), best
