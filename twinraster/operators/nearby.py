"""Neighbours of points in the plane without all pairs: a tree of square cells, descended for many points at once."""
from __future__ import annotations

import numpy as np

#: Levels of halving below the whole extent, and points that descend together.
LEVELS, BLOCK = 16, 4096


def _spread(v: np.ndarray) -> np.ndarray:
    """Sets the 16 low bits of every number apart, one free bit after each."""
    v = (v | v << 8) & 0x00FF00FF
    v = (v | v << 4) & 0x0F0F0F0F
    v = (v | v << 2) & 0x33333333
    return (v | v << 1) & 0x55555555


def _gather(v: np.ndarray) -> np.ndarray:
    """The inverse of ``_spread``."""
    v = v & 0x55555555
    v = (v | v >> 1) & 0x33333333
    v = (v | v >> 2) & 0x0F0F0F0F
    v = (v | v >> 4) & 0x00FF00FF
    return (v | v >> 8) & 0x0000FFFF


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of every element of the ranges ``start`` to ``stop``."""
    size = stop - start
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)


class CellTree:
    """Points in Z order; a cell of any level is a range of them, with the sum of its weights.

    Cells are halved until they hold at most ``leaf`` points, so that crowded places get small cells and the work follows the number of points.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, leaf: int = 8):
        extent = max(float(np.ptp(x)), float(np.ptp(y)), 1e-9) * (1 + 1e-9)
        self.origin, self.extent = (float(x.min()), float(y.min())), extent
        grid = [np.minimum((c - o) / extent * (1 << LEVELS), (1 << LEVELS) - 1).astype(np.int64) for c, o in zip((x, y), self.origin)]
        code = _spread(grid[0]) | _spread(grid[1]) << 1
        self.order = np.argsort(code, kind="stable")
        self.code, self.x, self.y = code[self.order], x[self.order], y[self.order]
        self.sums = np.concatenate([[0.0], np.cumsum(weight[self.order])])
        self.weight, self.leaf = weight[self.order], leaf

    def _distances(self, q: np.ndarray, prefix: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of points ``q`` to their cells."""
        side = self.extent / (1 << level)
        low, high = np.zeros(len(q)), np.zeros(len(q))
        for c, o, at in ((self.x, self.origin[0], _gather(prefix)), (self.y, self.origin[1], _gather(prefix >> 1))):
            start = o + at * side
            low += np.square(np.maximum(np.maximum(start - c[q], c[q] - start - side), 0))
            high += np.square(np.maximum(c[q] - start, start + side - c[q]))
        return np.sqrt(low), np.sqrt(high)

    def descend(self, q: np.ndarray, radius: np.ndarray, whole: bool):
        """Pairs (point of ``q``, other point) with cells that reach into the radius, and, with ``whole``, the sum of weights of cells that lie in it."""
        inside = np.zeros(len(q))
        who, prefix = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
        pairs = []
        for level in range(LEVELS + 1):
            low, high = self._distances(q[who], prefix, level)
            slack = 1e-9 * self.extent
            near = low <= radius[who] + slack
            shift = 2 * (LEVELS - level)
            start = np.searchsorted(self.code, prefix << shift)
            stop = np.searchsorted(self.code, (prefix + 1) << shift)
            if whole:
                full = high <= radius[who] - slack
                np.add.at(inside, who[full], self.sums[stop[full]] - self.sums[start[full]])
                near &= ~full
            near &= stop > start
            last = near & ((stop - start <= self.leaf) | (level == LEVELS))
            owner, other = _ranges(start[last], stop[last])
            pairs.append((who[last][owner], other))
            who, prefix = who[near & ~last], prefix[near & ~last]
            if not len(who):
                break
            who, prefix = np.repeat(who, 4), (prefix[:, None] * 4 + np.arange(4)).ravel()
        return inside, np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def neighbours(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance of every point to the nearest other one (inf for a single point), and the weight of all other points within ``reach``.

    The nearest of a point's neighbours in Z order bounds the search for the nearest of all. Points in one place are told apart by number: they
    are neighbours at distance 0 and end their search at once.
    """
    n = len(x)
    tree = CellTree(x, y, weight)
    bound = np.full(n, np.inf)
    for step in (1, 2, 3):
        if n > step:
            d = np.hypot(tree.x[step:] - tree.x[:-step], tree.y[step:] - tree.y[:-step])
            bound[step:], bound[:-step] = np.minimum(bound[step:], d), np.minimum(bound[:-step], d)
    nearest, close = np.empty(n), np.empty(n)
    for at in range(0, n, BLOCK):
        q = np.arange(at, min(n, at + BLOCK))
        best = bound[q].copy()
        seek = np.flatnonzero(best > 0)
        if n > 1 and len(seek):
            _, who, other = tree.descend(q[seek], best[seek], False)
            mine = other != q[seek][who]
            who, other = who[mine], other[mine]
            np.minimum.at(best, seek[who], np.hypot(tree.x[q[seek][who]] - tree.x[other], tree.y[q[seek][who]] - tree.y[other]))
        nearest[tree.order[q]] = best
        inside, who, other = tree.descend(q, np.full(len(q), reach), True)
        hit = np.hypot(tree.x[q[who]] - tree.x[other], tree.y[q[who]] - tree.y[other]) <= reach
        np.add.at(inside, who[hit], tree.weight[other[hit]])
        close[tree.order[q]] = inside - tree.weight[q]
    return nearest, close
