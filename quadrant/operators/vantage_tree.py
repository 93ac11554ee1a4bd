"""Vantage-point tree over points on a sphere, searched for many queries at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quadrant.functions.sphere import great_circle

LEAF = 64
PAIRS_AT_ONCE = 1_000_000


class VantageTree:
    """Points (radians) split at the median distance from a vantage point, down to leaves of at most LEAF points.

    Points at equal places are one tree point with several members, so ties cannot unbalance it.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray) -> None:
        order = np.lexsort((lat, lon))
        new = np.r_[True, (np.diff(lon[order]) != 0) | (np.diff(lat[order]) != 0)] if len(order) else np.zeros(0, bool)
        self.members = order
        self.first = np.r_[np.flatnonzero(new), len(order)]
        self.lon, self.lat = lon[order][new], lat[order][new]
        at = np.arange(len(self.lon))
        self.nodes: list[tuple] = []
        if len(at):
            self._build(at)

    def _build(self, at: np.ndarray) -> None:
        waiting = [(at, None, 0)]
        while waiting:
            at, parent, side = waiting.pop()
            here = len(self.nodes)
            if parent is not None:
                self.nodes[parent][2 + side] = here
            if len(at) <= LEAF:
                self.nodes.append([at, None, None, None])
                continue
            middle = at[len(at) // 2]
            away = great_circle(self.lon[middle], self.lat[middle], self.lon[at], self.lat[at])
            # The farthest point of a subset makes a better vantage point than one in its midst.
            vantage = at[np.argmax(away)]
            away = great_circle(self.lon[vantage], self.lat[vantage], self.lon[at], self.lat[at])
            half = len(at) // 2
            order = np.argpartition(away, half)
            near, far = order[:half], order[half:]
            self.nodes.append([vantage, (away[near].max(), away[far].min()), None, None])
            waiting.append((at[near], here, 0))
            waiting.append((at[far], here, 1))

    def within(self, lon: np.ndarray, lat: np.ndarray, metres: float | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, point index) arrays of all pairs at most ``metres`` (one bound, or one a query) apart, in pieces of bounded size."""
        if not self.nodes or not len(lon):
            return
        waiting = [(0, np.arange(len(lon)))]
        metres = np.broadcast_to(np.asarray(metres, float), len(lon))
        slack = metres + 1e-3
        while waiting:
            node, queries = waiting.pop()
            at, split, left, right = self.nodes[node]
            if split is None:
                step = max(1, PAIRS_AT_ONCE // len(at))
                for start in range(0, len(queries), step):
                    part = queries[start : start + step]
                    d = great_circle(lon[part][:, None], lat[part][:, None], self.lon[at][None, :], self.lat[at][None, :])
                    q, p = np.nonzero(d <= metres[part][:, None])
                    yield from self._expand(part[q], at[p])
                continue
            d = great_circle(self.lon[at], self.lat[at], lon[queries], lat[queries])
            for child, go in ((left, d - slack[queries] <= split[0]), (right, d + slack[queries] >= split[1])):
                if go.any():
                    waiting.append((child, queries[go]))

    def _expand(self, queries: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        counts = self.first[points + 1] - self.first[points]
        ends = np.cumsum(counts)
        start = 0
        while start < len(queries):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
            size = counts[start:stop]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(queries[start:stop], size), self.members[np.repeat(self.first[points[start:stop]], size) + offset]
            start = stop

    def nearest(self, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point index, metres) of the nearest point to each query; the lowest index of equals; -1 if there are no points."""
        best, who = np.full(len(lon), np.inf), np.full(len(lon), -1)
        if not self.nodes or not len(lon):
            return who, best
        head = self.members[self.first[:-1]]
        waiting = [(0, np.arange(len(lon)), np.zeros(len(lon)))]
        while waiting:
            node, queries, least = waiting.pop()
            queries = queries[least <= best[queries] + 1e-6]
            if not len(queries):
                continue
            at, split, left, right = self.nodes[node]
            if split is None:
                step = max(1, PAIRS_AT_ONCE // len(at))
                for start in range(0, len(queries), step):
                    part = queries[start : start + step]
                    d = great_circle(lon[part][:, None], lat[part][:, None], self.lon[at][None, :], self.lat[at][None, :])
                    low = d.min(axis=1)
                    index = np.where(d == low[:, None], head[at][None, :], np.iinfo(np.int64).max).min(axis=1)
                    better = (low < best[part]) | ((low == best[part]) & (index < who[part]))
                    best[part[better]], who[part[better]] = low[better], index[better]
                continue
            d = great_circle(self.lon[at], self.lat[at], lon[queries], lat[queries])
            from_left, from_right = np.maximum(0, d - split[0]), np.maximum(0, split[1] - d)
            inner = d <= (split[0] + split[1]) / 2
            # The likelier side is searched first, so that most of the other is never entered.
            waiting.append((right, queries[inner], from_right[inner]))
            waiting.append((left, queries[~inner], from_left[~inner]))
            waiting.append((left, queries[inner], from_left[inner]))
            waiting.append((right, queries[~inner], from_right[~inner]))
        return who, best
