"""A tree of minimum bounding boxes over integer vectors, packed by sort-tile-recursive, and its best-first search.

For a query vector ``q`` and a box ``[low, high]``, coordinate ``i`` of an inner product lies between ``q[i] * low[i]`` and
``q[i] * high[i]`` (in either order), so their sums bound the scores of all vectors in the box. A search holds a queue of boxes
by their upper bound and opens the best one first; a box outside every open score window, or strictly below the worst score
that is still wanted, is not opened. Equal bounds are opened, since a tie may win by its id.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 128
FAN = 16


def str_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in sort-tile-recursive order: sorted by one coordinate, cut into slabs, each slab by the next coordinate."""
    n, d = points.shape
    order = np.arange(n)
    if n <= leaf or not d:
        return order
    spread = np.argsort(-(points.max(axis=0) - points.min(axis=0)), kind="stable")
    axes = spread[: max(1, min(d, int(np.ceil(np.log2(n / leaf)))))]
    runs = [(0, n)]
    for depth, axis in enumerate(axes):
        cut = []
        for begin, end in runs:
            part = order[begin:end]
            order[begin:end] = part[np.argsort(points[part, axis], kind="stable")]
            pages = -(-(end - begin) // leaf)
            slabs = max(1, int(np.ceil(pages ** (1 / (len(axes) - depth)))))
            size = -(-pages // slabs) * leaf
            cut += [(at, min(at + size, end)) for at in range(begin, end, size)]
        runs = cut
    return order


class BoxTree:
    """``ids`` (ascending ids win ties) and ``points`` (one row each, integers) in packed order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        order = str_order(points, leaf)
        self.ids, self.points, self.leaf, self.fan = ids[order], points[order], leaf, fan
        starts = np.arange(0, max(1, len(points)), leaf)
        self.lows, self.highs = [np.minimum.reduceat(self.points, starts)], [np.maximum.reduceat(self.points, starts)]
        while len(self.lows[-1]) > 1:
            starts = np.arange(0, len(self.lows[-1]), fan)
            self.lows.append(np.minimum.reduceat(self.lows[-1], starts))
            self.highs.append(np.maximum.reduceat(self.highs[-1], starts))

    def bounds(self, query: np.ndarray, level: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that a vector in each box of a level can have."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        low, high = self.lows[level][begin:end], self.highs[level][begin:end]
        return low @ up + high @ down, high @ up + low @ down

    def search(self, query: np.ndarray, windows: list[tuple[float, float]], k: int, without=None) -> list[list[tuple[int, int]]]:
        """For each window ``(from, to)`` of scores, the best ``k`` (score, id) in it: higher scores first, then smaller ids.

        ``without``: an id that is not offered.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        floors = [low for low, _ in windows]
        if not len(self.points):
            return found
        top = len(self.lows) - 1
        least, most = self.bounds(query, top, 0, 1)
        queue = [(-most[0], least[0], top, 0)]
        while queue:
            upper, lower, level, box = heapq.heappop(queue)
            open_to = [w for w, (_, high) in enumerate(windows) if -upper >= floors[w] and lower <= high]
            if not open_to:
                continue
            if level:
                begin, end = box * self.fan, min((box + 1) * self.fan, len(self.lows[level - 1]))
                least, most = self.bounds(query, level - 1, begin, end)
                for at in range(end - begin):
                    heapq.heappush(queue, (-most[at], least[at], level - 1, begin + at))
                continue
            begin, end = box * self.leaf, (box + 1) * self.leaf
            scores, ids = self.points[begin:end] @ query, self.ids[begin:end]
            for w in open_to:
                hit = (scores >= floors[w]) & (scores <= windows[w][1])
                if without is not None:
                    hit &= ids != without
                if not hit.any():
                    continue
                merged = found[w] + list(zip(scores[hit].tolist(), ids[hit].tolist()))
                merged.sort(key=lambda pair: (-pair[0], pair[1]))
                found[w] = merged[:k]
                if len(found[w]) == k:
                    floors[w] = max(windows[w][0], found[w][-1][0])
        return [[(int(score), name) for score, name in hits] for hits in found]
