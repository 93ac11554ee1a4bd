"""Distances from many sources at once, and walks back along the shortest paths, in numpy.

The nodes of a graph are eliminated in rounds of independent ones of low degree; a node's neighbours at that time become neighbours of each other, at the sum of the ways.
Upwards a source reaches few nodes; downwards one sweep over the rounds gives its distance to every node, for all sources of a batch side by side. Graphs without small
separators, whose eliminated form would grow beyond MOST_TIMES their size, are refused (None), and searched by a heap instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from quadrant.operators.graphs import Adjacency

#: Links that elimination may make, for each that the graph has.
MOST_TIMES = 30
#: Directed links beyond which, and neighbours of one node beyond which, a graph is not eliminated; links shorter than this could be walked in circles.
MOST_LINKS, MOST_NEAR, SHORTEST = 600_000, 32, 1e-6
#: Sources swept side by side.
SIDE_BY_SIDE = 64


def eliminate(graph: Adjacency) -> dict | None:
    """Arrays for Sweep, or None if the graph is not one for it."""
    n, first = len(graph.nodes), graph.first
    if not n or len(graph.to) > MOST_LINKS or min(graph.w) < SHORTEST or max(np.diff(first)) > MOST_NEAR:
        return None
    near = [dict(zip(graph.to[first[v] : first[v + 1]], graph.w[first[v] : first[v + 1]], strict=True)) for v in range(n)]
    mixed = np.random.default_rng(7).permutation(n).tolist()
    left, rank, ups, rounds, links = list(range(n)), np.zeros(n, np.int32), [], [], 0
    while left:
        left.sort(key=lambda v: (len(near[v]), mixed[v]))
        most = len(near[left[len(left) // 2]])
        taken, blocked = [], set()
        for v in left:
            if len(near[v]) > most:
                break
            if v not in blocked:
                taken.append(v)
                blocked.update(near[v])
        taken.sort(key=lambda v: -len(near[v]))
        rounds.append(len(taken))
        for v in taken:
            rank[v] = len(ups)
            own = list(near[v].items())
            ups.append(own)
            links += len(own)
            for i, (a, wa) in enumerate(own):
                at_a = near[a]
                del at_a[v]
                for b, wb in own[:i]:
                    if wa + wb < at_a.get(b, np.inf):
                        at_a[b] = near[b][a] = wa + wb
        if links > MOST_TIMES * (len(graph.to) + 100):
            return None
        gone = set(taken)
        left = [v for v in left if v not in gone]
    size = np.array([len(u) for u in ups])
    to = rank[np.array([b for u in ups for b, _ in u], np.int64)] if links else np.zeros(0, np.int32)
    return {"rank": rank, "rounds": np.array(rounds), "size": size, "to": to, "w": np.array([w for u in ups for _, w in u], float)}


class Sweep:
    """Distances from batches of sources; nodes are named by their rank in the elimination."""

    def __init__(self, held: dict) -> None:
        self.rank, size, to, w = held["rank"], held["size"], held["to"], held["w"]
        begin = np.r_[0, np.cumsum(size)]
        self.n = len(size)
        tos, ws, cuts = to.tolist(), w.tolist(), begin.tolist()
        self.ups = [list(zip(tos[a:b], ws[a:b], strict=True)) for a, b in zip(cuts, cuts[1:], strict=False)]
        # From the last round to the first: (first row, last, the k-th upper neighbour of each row, its way), rows of a round being sorted by falling size.
        self.steps = []
        ends = np.cumsum(held["rounds"])
        for low, high in zip((ends - held["rounds"])[::-1].tolist(), ends[::-1].tolist(), strict=True):
            for k in range(int(size[low])):
                stop = low + int((size[low:high] > k).sum())
                at = begin[low:stop] + k
                self.steps.append((low, stop, to[at], w[at][:, None]))

    def distances(self, sources: list[int]) -> np.ndarray:
        """One row a node, one column a source (ranks); infinite where no path leads."""
        far = np.full((self.n, len(sources)), np.inf)
        for column, s in enumerate(sources):
            dist, waiting = {s: 0.0}, [s]
            while waiting:
                v = heapq.heappop(waiting)
                d = dist[v]
                for u, w in self.ups[v]:
                    known = dist.get(u)
                    if known is None:
                        heapq.heappush(waiting, u)
                    if known is None or d + w < known:
                        dist[u] = d + w
            far[np.fromiter(dist, np.int64, len(dist)), column] = np.fromiter(dist.values(), float, len(dist))
        for low, stop, to, w in self.steps:
            np.minimum(far[low:stop], far[to] + w, out=far[low:stop])
        return far


class Neighbours:
    """The neighbours of each node as a table, in order of their ids, by rank: to, way."""

    def __init__(self, graph: Adjacency, rank: np.ndarray) -> None:
        first = np.array(graph.first)
        size = np.diff(first)
        n, most = len(size), int(size.max(initial=0))
        row = np.repeat(np.arange(n), size)
        slot = np.arange(len(row)) - first[row]
        self.node = np.argsort(rank)
        self.to = np.zeros((n, most), np.int32)
        self.w = np.full((n, most), np.inf)
        self.to[rank[row], slot] = rank[np.array(graph.to, np.int64)]
        self.w[rank[row], slot] = graph.w

    def walk_back(self, far: np.ndarray, column: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(walk, node, its slot that leads on, whether that is the source), a step at a time, from each end back to its column's source.

        Of equally long ways, that over the node nearest to the source, then with the least id, is taken, as Adjacency.paths does.
        """
        walk, at = np.arange(len(ends)), ends
        while len(walk):
            to = self.to[at]
            before = far[to, column[walk][:, None]]
            here = far[at, column[walk]]
            fits = before + self.w[at] <= (here + 1e-7 + here * 1e-12)[:, None]
            slot = np.where(fits, before, np.inf).argmin(axis=1)
            next_ = to[np.arange(len(at)), slot]
            over = far[next_, column[walk]] == 0
            yield walk, at, slot, over
            walk, at = walk[~over], next_[~over]
