"""Nearest-point joins and bounded variants.

Up to HELD_POINTS distinct target places go to the executors as one vantage-point tree, and nothing shuffles. Beyond, both sides meet in the Voronoi cells of
pivots taken from the targets, in two passes: in the first a query finds the nearest target of its own cell, which bounds how far the
nearest of all can be; in the second it goes only to the other cells that can hold a nearer one. Cells with many queries are cut
into columns of blocks; targets at one place are one target.

Defined results: unusable coordinates on either side take no part; without targets there are no rows; of targets equally near the
one with the lowest id is taken; repeated queries have a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.operators.vantage_tree import VantageTree
from quadrant.operators.voronoi_join import CELL_POINTS, QUERY, SLACK_M, TARGET, Layout, Near, by_cell, plan_layout, spots, usable, voronoi_join
from quadrant.sources.tables import cut, slots

HELD_POINTS = 1_000_000
PASS = "query_id long, lon double, lat double, target_id long, metres double"


def nearest_join(queries: DataFrame, query_id: str, targets: DataFrame, target_id: str, held_points: int = HELD_POINTS, cell_points: int = CELL_POINTS) -> DataFrame:
    """(query_id, target_id, metres) of every query's nearest target; both tables have lon and lat."""
    asked = usable(queries, query_id, 0)
    held = usable(targets, target_id, 1).groupBy("lon", "lat").agg(F.min("id").alias("id")).select(F.lit(1).alias("source"), "id", "lon", "lat")
    if held.limit(held_points + 1).count() <= held_points:
        points = held.toPandas().sort_values("id")
        sent = asked.sparkSession.sparkContext.broadcast({"points": tuple(points[c].to_numpy() for c in ("id", "lon", "lat"))})
        return asked.select("id", "lon", "lat").mapInArrow(_searcher(sent), "query_id long, target_id long, metres double")
    return _in_cells(asked, held, cell_points)


def _in_cells(asked: DataFrame, held: DataFrame, cell_points: int) -> DataFrame:
    spark = asked.sparkSession
    once = asked.groupBy("id", "lon", "lat").agg(F.count(F.lit(1)).alias("n"))
    held = cut(held)
    layout = plan_layout(held.unionByName(asked), {0}, {1}, cell_points, pivots_from=1)
    shared = spark.sparkContext.broadcast((layout.lon, layout.lat, layout.rows, layout.columns))
    routed_targets = held.select("id", "lon", "lat").mapInArrow(_to_blocks(shared, TARGET), f"cell long, role int, {PASS}")

    def meet(routed: DataFrame) -> DataFrame:
        together = routed_targets.unionByName(routed).repartition(4 * slots(spark), "cell").sortWithinPartitions("cell")
        found = together.mapInArrow(_nearest_in_cells, PASS)
        return found.groupBy("query_id", "lon", "lat").agg(F.min(F.struct("metres", "target_id")).alias("b"))

    first = cut(meet(once.select("id", "lon", "lat").mapInArrow(_to_blocks(shared, QUERY), f"cell long, role int, {PASS}")))
    # Where the first pass found nothing (two pivots of one place but for rounding), the way to the pivot, a target itself, is the bound.
    again = once.select(F.col("id").alias("query_id"), "lon", "lat").join(first, ["query_id", "lon", "lat"], "left").select(F.col("query_id").alias("id"), "lon", "lat", F.coalesce("b.metres", F.lit(float("nan"))).alias("metres"))
    second = meet(again.mapInArrow(_to_blocks(shared, QUERY, True), f"cell long, role int, {PASS}"))
    best = first.unionByName(second).groupBy("query_id", "lon", "lat").agg(F.min("b").alias("b"))
    rows = best.join(once.select(F.col("id").alias("query_id"), "lon", "lat", "n"), ["query_id", "lon", "lat"])
    return rows.select("query_id", F.col("b.target_id").alias("target_id"), F.col("b.metres").alias("metres"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")


def _to_blocks(shared, role: int, bounded: bool = False):
    """Targets to their cell; queries to their own cell, or, ``bounded``, to the other cells that may hold a nearer target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Layout(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                ids, lon, lat = (part.column(i).to_numpy() for i in range(3))
                x, y = np.radians(lon), np.radians(lat)
                home, own = grid.tree.nearest(x, y)
                if role == TARGET:
                    who, blocks = grid.target_blocks(home, spots(ids))
                elif not bounded:
                    who, blocks = grid.query_blocks(home, spots(ids))
                else:
                    known = part.column(3).to_numpy()
                    q, cell = grid.cells_within(x, y, own + 2 * np.where(np.isnan(known), own, known) + SLACK_M)
                    q, cell = q[cell != home[q]], cell[cell != home[q]]
                    who, blocks = grid.query_blocks(cell, spots(ids[q]))
                    who = q[who]
                n = len(who)
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(np.full(n, role, np.int32)), pa.array(ids[who], pa.int64()), pa.array(lon[who]), pa.array(lat[who]), nothing, pa.nulls(n, pa.float64())], names=["cell", "role", "query_id", "lon", "lat", "target_id", "metres"])

    return run


def _nearest_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in by_cell(batches):
        role, ids, lon, lat = (cell.column(i).to_numpy() for i in (1, 2, 3, 4))
        held, asks = np.flatnonzero(role == TARGET), np.flatnonzero(role == QUERY)
        if not len(held) or not len(asks):
            continue
        held = held[np.argsort(ids[held])]
        at, metres = VantageTree(np.radians(lon[held]), np.radians(lat[held])).nearest(np.radians(lon[asks]), np.radians(lat[asks]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[asks], pa.int64()), pa.array(lon[asks]), pa.array(lat[asks]), pa.array(ids[held[at]], pa.int64()), pa.array(metres)], names=["query_id", "lon", "lat", "target_id", "metres"])


def _searcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        if "tree" not in held:
            held["tree"] = held["points"][0], VantageTree(*(np.radians(c) for c in held["points"][1:]))
        ids, tree = held["tree"]
        for batch in batches:
            x, y = (np.radians(batch.column(i).to_numpy()) for i in (1, 2))
            at, metres = tree.nearest(x, y)
            keep = np.flatnonzero(at >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(ids[at[keep]], pa.int64()), pa.array(metres[keep])], names=["query_id", "target_id", "metres"])

    return run


def within_join(queries: DataFrame, query_id: str, targets: DataFrame, target_id: str, metres: float) -> DataFrame:
    """(query_id, target_id) of all pairs at most ``metres`` apart."""
    found = voronoi_join(queries.sparkSession, {"q": (queries, query_id), "t": (targets, target_id)}, [Near("pair", "q", "t", metres)])
    return found.select(F.col("point_id").alias("query_id"), F.col("other_id").alias("target_id"))


def without_near(queries: DataFrame, query_id: str, targets: DataFrame, target_id: str, metres: float) -> DataFrame:
    """The queries that have no target within ``metres``; those without a usable position stay."""
    near = within_join(queries, query_id, targets, target_id, metres).select(F.col("query_id").alias(query_id)).distinct()
    return queries.join(near, query_id, "left_anti")


def nearest_within(queries: DataFrame, query_id: str, targets: DataFrame, target_id: str, metres: float) -> DataFrame:
    """(query_id, target_id, metres) of each query's nearest target, if it is at most ``metres`` away."""
    return nearest_join(queries, query_id, targets, target_id).filter(F.col("metres") <= metres)
