"""Graph operators: connected components by randomised contraction, and shortest paths from many sources.

Edges are (src, dst) or (src, dst, w) DataFrames; each is taken in both directions. What is left of a graph is counted before every step: up to
``local_edges`` edges are solved in one pass (components in one task, paths by a heap per source over a broadcast adjacency); beyond, rounds of
joins run, whose lineage is cut in the shared folder. Both ways give the same rows. Only counters and the
adjacency of a graph of checked size come to the driver.

Defined results: edges with a null end are left out; loops and repeated edges change nothing; of parallel edges the lightest counts; negative and
null weights are not allowed and dropped; an empty edge table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.sources.tables import cut

#: Edges (each counted once) up to which a graph is held by one task: about 100 MB.
LOCAL_EDGES = 2_000_000
#: A key with more than one of so many rows is joined by a broadcast of its one partner, so that no task gets all its rows.
HOT_PART = 1_000
#: Rounds between compactions of the log of distances.
COMPACT = 16


def both_ways(edges: DataFrame, *weights: str) -> DataFrame:
    """Each edge in both directions, once, the lightest of parallel ones."""
    clean = edges.filter("src is not null and dst is not null and src <> dst")
    for w in weights:
        clean = clean.filter((F.col(w) >= 0) & ~F.isnan(w))
    doubled = clean.select("src", "dst", *weights).unionByName(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *weights))
    if not weights:
        return doubled.distinct()
    return doubled.groupBy("src", "dst").agg(*(F.min(w).alias(w) for w in weights))


def join_hot(rows: DataFrame, key: str, lookup: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup``, which has each ``key`` once; keys with a thousandth of the rows and more go by a broadcast of at most that many."""
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(total // HOT_PART, 100_000)).select(key)
    hot = cut(hot)
    if hot.isEmpty():
        return rows.join(lookup, key, how)
    few = cut(lookup.join(F.broadcast(hot), key, "left_semi"))
    many = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how)
    return many.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(lookup, key, how))


def _least_members(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node each is connected to), by hooking and pointer jumping over whole arrays."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    parent = np.arange(len(nodes))
    while len(a):
        low = np.minimum(parent[a], parent[b])
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[parent]


def _local_components(edges: DataFrame) -> DataFrame:
    """(node, component) in one task."""
    kind = dict(edges.dtypes)["src"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            nodes, low = _least_members(*(rows.column(i).to_numpy() for i in range(2)))
            for start in range(0, len(nodes), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[part], rows.schema.field(0).type) for x in (nodes, low)], names=["node", "component"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component): the least node that each node is connected to.

    Every round each node takes, of itself and its neighbours, the one that a fresh hash puts first, and nodes with one choice become one.
    A node stays only if it comes first among its neighbours, so the expected number of nodes falls by a constant factor whatever the shape of the graph
    (paths, grids, stars; any order of ids), and the rounds are logarithmic. The least member travels with each node.
    """
    clean = edges.filter("src is not null and dst is not null").select("src", "dst")
    loops = clean.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left = cut(clean.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    chosen: list[DataFrame] = []
    while left.count() > local_edges:
        put = lambda c: F.xxhash64(F.lit(len(chosen)), c)
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = both.groupBy(F.col("src").alias("node")).agg(F.min(F.struct(put("dst").alias("h"), F.col("dst").alias("k"))).alias("f"))
        picked = cut(first.select("node", F.when(put("node") < F.col("f.h"), F.col("node")).otherwise(F.col("f.k")).alias("rep")))
        chosen.append(picked)
        a = join_hot(left, "src", picked.withColumnRenamed("node", "src")).select(F.col("rep").alias("s"), "dst")
        b = join_hot(a, "dst", picked.withColumnRenamed("node", "dst")).select("s", F.col("rep").alias("d"))
        left = cut(b.filter("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct())
    found = _local_components(left)
    if chosen:
        # Back through the rounds: a node has the end of its choice; a choice that was left without edges is an end itself.
        for picked in reversed(chosen):
            ends = cut(found).withColumnsRenamed({"node": "rep", "component": "end"})
            found = join_hot(picked, "rep", ends, "left").select("node", F.coalesce("end", "rep").alias("component"))
        found = cut(found)
        least = found.groupBy("component").agg(F.min("node").alias("low"))
        found = join_hot(found, "component", least).select("node", F.col("low").alias("component"))
    found = cut(found)
    return found.unionByName(loops.join(found, "node", "left_anti").distinct())


def component_sizes(found: DataFrame) -> DataFrame:
    """(component, nodes), the largest first, of equals the least."""
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the component with the most nodes, the one with the least node of equals."""
    found = components(edges)
    return found.join(F.broadcast(component_sizes(found).limit(1).select("component")), "component").select("node")


def component_of(edges: DataFrame, node: object) -> DataFrame:
    """(node) of the component that holds a node; none if the node has no edge."""
    found = components(edges)
    return found.join(F.broadcast(found.filter(F.col("node") == F.lit(node)).select("component")), "component").select("node")


class Adjacency:
    """A graph held by one worker: for each node the slice of its neighbours, in order of their ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        self.nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = at[: len(src)], at[len(src) :]
        order = np.lexsort((b, a))
        self.to, self.w = b[order].tolist(), w[order].tolist()
        self.first = np.searchsorted(a[order], np.arange(len(self.nodes) + 1)).tolist()
        self.number = {n: i for i, n in enumerate(self.nodes.tolist())}

    def paths(self, source: int, cap: float | None = None, past_cap: bool = False, until: set[int] | None = None) -> tuple[dict[int, float], dict[int, int]]:
        """(distance, predecessor) of the nodes reached, those not farther than ``cap``; with ``past_cap`` also those one edge beyond.

        Of equally long paths, the predecessor nearest to the source, then the least, is kept. Ends early when all of ``until`` are settled.
        """
        dist, before, done, heap = {source: 0.0}, {}, set(), [(0.0, source)]
        wanted = set(until) if until is not None else None
        to, w, first = self.to, self.w, self.first
        while heap:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            if cap is not None and d > cap:
                break
            done.add(n)
            if wanted is not None:
                wanted.discard(n)
                if not wanted:
                    break
            for e in range(first[n], first[n + 1]):
                m, far = to[e], d + w[e]
                if far < dist.get(m, np.inf):
                    dist[m] = far
                    before[m] = n
                    heapq.heappush(heap, (far, m))
        if cap is not None and not past_cap:
            dist = {n: d for n, d in dist.items() if d <= cap}
        elif until is not None:
            dist = {n: dist[n] for n in done}
        return dist, before


def held_adjacency(edges: DataFrame, local_edges: int = LOCAL_EDGES):
    """The adjacency of a graph as a broadcast, or None if it has more than ``local_edges`` edges; a worker builds it once."""
    links = edges.filter("src is not null and dst is not null and src <> dst and w >= 0").groupBy("src", "dst").agg(F.min("w").alias("w"))
    if links.limit(local_edges + 1).count() > local_edges:
        return None
    rows = both_ways(links, "w").toPandas()
    return edges.sparkSession.sparkContext.broadcast({"rows": tuple(rows[c].to_numpy() for c in ("src", "dst", "w"))})


def built(sent) -> Adjacency:
    held = sent.value
    if "graph" not in held:
        held["graph"] = Adjacency(*held.pop("rows"))
    return held["graph"]


def shortest_distances(edges: DataFrame, sources: DataFrame, cap: float | None = None, past_cap: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, node, dist) of every node reachable from each source, not farther than ``cap``.

    With ``past_cap`` the cap bounds only which nodes are gone on from: their neighbours beyond it keep their distance.
    A source without edges reaches itself.
    """
    return _paths(edges, sources, cap, past_cap, local_edges).drop("parent")


def shortest_tree(edges: DataFrame, sources: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, node, dist, parent): distances with the least neighbour each shortest path may come from; null at the source."""
    return _paths(edges, sources, None, False, local_edges)


def _paths(edges: DataFrame, sources: DataFrame, cap: float | None, past_cap: bool, local_edges: int) -> DataFrame:
    asked = sources.filter("node is not null").select("node").distinct()
    sent = held_adjacency(edges, local_edges)
    if sent is None:
        return _with_parents(edges, _relaxed(edges, asked, cap, past_cap))
    kind = dict(asked.dtypes)["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = built(sent)
        for batch in batches:
            of = batch.schema.field(0).type
            for source in batch.column(0).to_pylist():
                at = graph.number.get(source)
                if at is None:
                    yield pa.RecordBatch.from_arrays([pa.array([source], of), pa.array([source], of), pa.array([0.0]), pa.array([None], of)], names=["source", "node", "dist", "parent"])
                    continue
                dist, _ = graph.paths(at, cap, past_cap)
                nodes, far = np.fromiter(dist, np.int64, len(dist)), np.fromiter(dist.values(), float, len(dist))
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(nodes), of), pa.array(graph.nodes[nodes], of), pa.array(far), pa.array(_parents(graph, dist, nodes), of)], names=["source", "node", "dist", "parent"])

    return asked.mapInArrow(run, f"source {kind}, node {kind}, dist double, parent {kind}")


def _parents(graph: Adjacency, dist: dict[int, float], nodes: np.ndarray) -> list:
    """The least neighbour that each node's shortest path may come from."""
    found = []
    for n in nodes.tolist():
        d = dist[n]
        edges = range(graph.first[n], graph.first[n + 1])
        found.append(next((graph.nodes[graph.to[e]].item() for e in edges if d > 0 and abs(dist.get(graph.to[e], np.inf) + graph.w[e] - d) <= 1e-9), None))
    return found


def _relaxed(edges: DataFrame, asked: DataFrame, cap: float | None, past_cap: bool) -> DataFrame:
    """shortest_distances by rounds: each relaxes only the edges of nodes whose distance fell in the last one.

    Falls are appended to a log that is compacted every COMPACT rounds; a round touches the log only at the nodes it reached.
    """
    links = cut(both_ways(edges, "w"))
    log = cut(asked.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")))
    frontier, rounds = log, 0
    while True:
        near = frontier if cap is None else frontier.filter(F.col("dist") <= cap)
        reached = near.join(links, near["node"] == links["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("new"))
        if cap is not None and not past_cap:
            reached = reached.filter(F.col("new") <= cap)
        offered = reached.groupBy("source", "node").agg(F.min("new").alias("new"))
        known = log.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        frontier = cut(offered.join(known, ["source", "node"], "left").filter("dist is null or new < dist").select("source", "node", F.col("new").alias("dist")))
        if frontier.isEmpty():
            return known
        log = log.unionByName(frontier)
        rounds += 1
        if rounds % COMPACT == 0:
            log = cut(log.groupBy("source", "node").agg(F.min("dist").alias("dist")))


def _with_parents(edges: DataFrame, found: DataFrame) -> DataFrame:
    dist, links = cut(found), both_ways(edges, "w")
    before = dist.select(F.col("source").alias("s"), F.col("node").alias("p"), F.col("dist").alias("d"))
    steps = dist.join(links, dist["node"] == links["dst"]).join(before, (F.col("source") == F.col("s")) & (F.col("src") == F.col("p")))
    good = steps.filter((F.abs(F.col("d") + F.col("w") - F.col("dist")) <= 1e-9) & (F.col("dist") > 0)).groupBy("source", "node").agg(F.min("p").alias("parent"))
    return dist.join(good, ["source", "node"], "left").select("source", "node", "dist", "parent")
