"""Regions of a mask as runs: membership, components, centres and distances without a canvas of pixels.

A region is its runs cut at the columns of the mask: segments (column, first row, row after the last), in order. A segment
stands for all its pixels, so work goes with the number of segments and not with the size of the mask.
"""

from __future__ import annotations

import numpy as np


class Region:
    """Disjoint segments by column and row, of a mask of ``h`` rows and ``w`` columns."""

    def __init__(self, x: np.ndarray, top: np.ndarray, end: np.ndarray, h: int, w: int):
        self.x, self.top, self.end, self.h, self.w = x, top, end, h, w

    def __len__(self) -> int:
        return len(self.x)

    def part(self, rows: np.ndarray) -> Region:
        return Region(self.x[rows], self.top[rows], self.end[rows], self.h, self.w)

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pixels (whole numbers) lie in the region."""
        if not len(self):
            return np.zeros(len(x), bool)
        at = np.searchsorted(self.x * self.h + self.top, x * self.h + y, side="right") - 1
        k = np.maximum(at, 0)
        return (at >= 0) & (x >= 0) & (x < self.w) & (y >= 0) & (y < self.h) & (self.x[k] == x) & (y < self.end[k])

    def centre(self) -> tuple[float, float]:
        """Mean column and row of the pixels; the middle of the mask for none."""
        if not len(self):
            return self.w / 2, self.h / 2
        many = self.end - self.top
        return float((self.x * many).sum() / many.sum()), float(((self.top + self.end - 1) * many).sum() / 2 / many.sum())

    def components(self) -> np.ndarray:
        """Numbers from 0 of the 4-connected regions that segments belong to, in row-major order of their first pixels.

        Segments of neighbouring columns that share a row are joined.
        """
        n = len(self)
        if not n:
            return np.zeros(0, np.int64)
        tops, ends = self.x * (self.h + 1) + self.top, self.x * (self.h + 1) + self.end
        low = np.searchsorted(ends, tops + self.h + 1, side="right")
        high = np.searchsorted(tops, ends + self.h + 1, side="left")
        many = np.maximum(high - low, 0)
        a = np.repeat(np.arange(n), many)
        b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        up = np.arange(n)
        while len(a):
            # each root takes the least root next to it; then all point at their roots
            p, q = up[a], up[b]
            apart = p != q
            if not apart.any():
                break
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
            while (up[up] != up).any():
                up = up[up]
        first = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(first, up, self.top * self.w + self.x)
        roots = np.flatnonzero(up == np.arange(n))
        number = np.empty(n, np.int64)
        number[roots[np.argsort(first[roots])]] = np.arange(len(roots))
        return number[up]

    def distance(self, x: float, y: float) -> float:
        """Least distance of a point from a pixel; infinite for no region."""
        if not len(self):
            return float("inf")
        rows = [np.clip(f(y), self.top, self.end - 1) for f in (np.floor, np.ceil)]
        return float(min(np.hypot(self.x - x, r - y).min() for r in rows))

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``distance`` of each point."""
        if not len(self):
            return np.full(len(x), np.inf)
        rows = [np.clip(f(y)[:, None], self.top, self.end - 1) for f in (np.floor, np.ceil)]
        return np.minimum(*(np.hypot(self.x - x[:, None], r - y[:, None]).min(1) for r in rows))

    def gap(self, other: Region, step: int = 256) -> float:
        """Least distance between pixels of two regions; infinite if one is empty.

        Segments nearest to the other region's box come first, so that most others are ruled out by their distance from it.
        """
        if not len(self) or not len(other):
            return float("inf")
        across = np.maximum(0, np.maximum(other.x[0] - self.x, self.x - other.x[-1]))
        along = np.maximum(0, np.maximum(other.top.min() - self.end + 1, self.top - other.end.max() + 1))
        least = across * across + along * along
        order, best = np.argsort(least, kind="stable"), np.iinfo(np.int64).max
        for i in range(0, len(order), step):
            k = order[i : i + step]
            if least[k[0]] >= best:
                break
            dx = self.x[k, None] - other.x[None]
            dy = np.maximum(0, np.maximum(other.top[None] - self.end[k, None] + 1, self.top[k, None] - other.end[None] + 1))
            best = min(best, int((dx * dx + dy * dy).min()))
        return float(np.sqrt(best))


def region(starts: np.ndarray, ends: np.ndarray, h: int, w: int) -> Region:
    """The region of column-major runs [start, end) in any order, which may overlap and go beyond the mask."""
    s, e = np.clip(starts, 0, h * w), np.clip(ends, 0, h * w)
    order = np.argsort(s[s < e], kind="stable")
    s, e = s[s < e][order], e[s < e][order]
    if not len(s):
        none = np.zeros(0, np.int64)
        return Region(none, none, none, h, w)
    # runs that overlap or touch become one
    reach = np.maximum.accumulate(e)
    new = np.concatenate([[True], s[1:] > reach[:-1]])
    s, e = s[new], np.concatenate([reach[:-1][new[1:]], reach[-1:]])
    first, last = s // h, (e - 1) // h
    many = last - first + 1
    of = np.repeat(np.arange(len(s)), many)
    x = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[of]
    return Region(x, np.maximum(s[of] - x * h, 0), np.minimum(e[of] - x * h, h), h, w)
