"""Exact nearest entries of an integer codebook by a geometric near-neighbour access tree."""

from __future__ import annotations

import numpy as np

#: Relative error that no square root, sum or difference here exceeds.
_SLACK = 2.0**-48


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each query (row) and point (column), exact in 64 bits."""
    d = queries[:, None, :] - points[None, :, :]
    return np.einsum("qpd,qpd->qp", d, d)


def largest_component(dims: int) -> int:
    """Up to this size of component, squared distances of so many dimensions fit into 64 bits."""
    return int((((1 << 63) - 1) // max(dims, 1)) ** 0.5 / 2) - 1


class _Node:
    """Split points (numbers of entries), a subtree of the entries next to each, and the ranges of distances from each point to each subtree."""

    __slots__ = ("points", "children", "low", "high")


class NeighbourTree:
    """Over ``entries`` (n x dims integers); ``nearest`` gives the lowest number of those at the least distance.

    A node has up to ``degree`` split points, each as far as possible from
    those before.  Every other entry goes to the subtree of its nearest
    point.  For each point and each subtree the least and largest distance
    from the point to an entry of the subtree (its own point included) are
    kept, rounded outwards.  A query at distance d from a point drops all
    subtrees whose range lies wholly beyond d plus or minus its best distance
    so far.  Distances are integers, squared; only the ranges need roots, and
    these are rounded so that what is dropped is strictly farther: entries at
    equal distance are always compared, and the lower number wins.
    """

    def __init__(self, entries: np.ndarray, degree: int = 16):
        self.entries, self.degree = np.ascontiguousarray(entries, dtype=np.int64), degree
        self.compared = 0  # distances computed so far
        self.root = self._grow(np.arange(len(entries))) if len(entries) else None

    def _grow(self, members: np.ndarray) -> _Node:
        node, x = _Node(), self.entries[members]
        far = squared(x, x[:1])[:, 0]
        chosen, to = [0], [far]
        while len(chosen) < min(self.degree, len(members)):
            nearest = np.min(to, axis=0)
            nearest[chosen] = -1
            chosen.append(int(np.argmax(nearest)))
            to.append(squared(x, x[chosen[-1] :][:1])[:, 0])
        d = np.array(to)  # points x members
        rest = np.ones(len(members), bool)
        rest[chosen] = False
        goes = np.argmin(d, axis=0)
        goes[chosen] = np.arange(len(chosen))
        root = np.sqrt(d.astype(np.float64))
        node.points = members[chosen]
        node.low = np.stack([root[:, goes == j].min(axis=1) for j in range(len(chosen))], axis=1) * (1 - _SLACK)
        node.high = np.stack([root[:, goes == j].max(axis=1) for j in range(len(chosen))], axis=1) * (1 + _SLACK)
        node.children = [self._grow(m) if len(m := members[rest & (goes == j)]) else None for j in range(len(chosen))]
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each query's nearest entry."""
        queries = np.ascontiguousarray(queries, dtype=np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        at = np.full(len(queries), len(self.entries))
        if self.root is not None:
            self._search(self.root, queries, np.arange(len(queries)), best, at)
        return at, best

    def _search(self, node: _Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        k = len(node.points)
        alive = np.ones((len(rows), k), bool)
        beyond = np.zeros((len(rows), k))  # what each subtree's entries are away at least
        closest, to = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
        for i in range(k):
            mine = np.flatnonzero(alive[:, i])
            if not len(mine):
                continue
            of = rows[mine]
            d = squared(queries[of], self.entries[node.points[i : i + 1]])[:, 0]
            self.compared += len(mine)
            better = (d < best[of]) | ((d == best[of]) & (node.points[i] < at[of]))
            best[of[better]], at[of[better]] = d[better], node.points[i]
            nearer = d < to[mine]
            closest[mine[nearer]], to[mine[nearer]] = i, d[nearer]
            root = np.sqrt(d.astype(np.float64))[:, None]
            gap = np.maximum(node.low[i] - root * (1 + _SLACK), root * (1 - _SLACK) - node.high[i]) * (1 - _SLACK)
            beyond[mine] = np.maximum(beyond[mine], gap)
            radius = np.sqrt(best[of].astype(np.float64))[:, None] * (1 + _SLACK)
            alive[mine] &= ~(gap > radius)
        for first in (True, False):  # each query's nearest point's subtree first, as it shortens the best distance most
            for j in range(k):
                if node.children[j] is not None:
                    radius = np.sqrt(best[rows].astype(np.float64)) * (1 + _SLACK)
                    into = np.flatnonzero(alive[:, j] & ((closest == j) == first) & ~(beyond[:, j] > radius))
                    if len(into):
                        self._search(node.children[j], queries, rows[into], best, at)
