"""Joins between points and areas: first containing, containing else near, and nearest edge within a reach.

Areas are polygons (rings; holes after the first). Containment runs through the Voronoi join. For nearness, edges are cut into
cells of a fixed grid, widened by the reach, and meet the points of the cell by an equi-join, so neither side is broadcast and no area is
compared with all points.

Defined results: unusable coordinates and outlines of fewer than three corners match nothing; ties go as each function says;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrant.functions import geo, shapes
from quadrant.functions.geo import FLAT_MODELS, FlatModel
from quadrant.operators.voronoi_join import Within, voronoi_join

#: Degrees of a cell of the edge grid, about 110 m.
CELL_DEG = 0.001


def containing(points: DataFrame, point_id: str, areas: DataFrame, area_id: str) -> DataFrame:
    """(point_id, area_id) of all containments; points: lon, lat; areas: rings."""
    found = voronoi_join(points.sparkSession, {"p": (points, point_id)}, [], {"a": (areas, area_id)}, [Within("in", "p", "a")])
    return found.select(F.col("point_id").alias("point"), F.col("other_id").alias("area"))


def first_containing(points: DataFrame, point_id: str, areas: DataFrame, area_id: str) -> DataFrame:
    """(point, area): the containing area with the lowest id."""
    return containing(points, point_id, areas, area_id).groupBy("point").agg(F.min("area").alias("area"))


def _cells(ax: Column, ay: Column, bx: Column, by: Column, wide: Column, high: float) -> Column:
    span = lambda lo, hi, more: F.sequence(F.floor((F.least(lo, hi) - more) / CELL_DEG), F.floor((F.greatest(lo, hi) + more) / CELL_DEG))
    return F.flatten(F.transform(span(ax, bx, wide), lambda i: F.transform(span(ay, by, F.lit(high)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def near_edges(points: DataFrame, point_id: str, areas: DataFrame, area_id: str, reach_m: float, model: FlatModel = FLAT_MODELS["D3"]) -> DataFrame:
    """(point, area, metres): every area with an edge at most ``reach_m`` from a point, and the distance to its nearest edge (hole edges too)."""
    edges = areas.filter(F.col(area_id).isNotNull()).select(F.col(area_id).alias("area"), F.explode("rings").alias("r")).select("area", F.explode(shapes.pairs(F.col("r"))).alias("e"))
    # Long edges are cut, so that the boxes of their cells stay small.
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("e.b.lon") - F.col("e.a.lon")), F.abs(F.col("e.b.lat") - F.col("e.a.lat"))) / (4 * CELL_DEG))).cast("int")
    at = lambda k, t: F.col(f"e.a.{k}") + (F.col(f"e.b.{k}") - F.col(f"e.a.{k}")) * t
    cut = edges.withColumn("n", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    ends = [(at("lon", F.col("k") / F.col("n")), at("lat", F.col("k") / F.col("n"))), (at("lon", (F.col("k") + 1) / F.col("n")), at("lat", (F.col("k") + 1) / F.col("n")))]
    wide, high = F.lit(reach_m / model.lon_m * 1.01), reach_m / model.lat_m * 1.01
    placed = cut.select("area", "e", F.explode(_cells(ends[0][0], ends[0][1], ends[1][0], ends[1][1], wide, high)).alias("c")).distinct()
    own = points.select(F.col(point_id).alias("point"), "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90")
    own = own.withColumn("c", F.struct(F.floor(F.col("lon") / CELL_DEG).alias("i"), F.floor(F.col("lat") / CELL_DEG).alias("j")))
    lon, lat = F.col("lon"), F.col("lat")
    away = geo.to_segment(F.lit(0.0), F.lit(0.0), (F.col("e.a.lon") - lon) * model.lon_m, (F.col("e.a.lat") - lat) * model.lat_m, (F.col("e.b.lon") - lon) * model.lon_m, (F.col("e.b.lat") - lat) * model.lat_m)
    met = own.join(placed, "c").withColumn("metres", away).filter(F.col("metres") <= reach_m)
    return met.groupBy("point", "area").agg(F.min("metres").alias("metres"))


def containing_else_near(points: DataFrame, point_id: str, areas: DataFrame, area_id: str, reach_m: float) -> DataFrame:
    """(point, area, metres): the first containing area, else the nearest within reach, of equally near ones the last; 0 metres inside."""
    inside = first_containing(points, point_id, areas, area_id).withColumn("metres", F.lit(0.0))
    near = near_edges(points, point_id, areas, area_id, reach_m)
    best = near.groupBy("point").agg(F.min(F.struct("metres", (-F.col("area")).alias("last"))).alias("b")).select("point", (-F.col("b.last")).alias("area"), F.col("b.metres").alias("metres"))
    return inside.unionByName(best.join(inside.select("point"), "point", "left_anti"))


def nearest_edge_within(points: DataFrame, point_id: str, areas: DataFrame, area_id: str, reach_m: float) -> DataFrame:
    """(point, area, metres): the area with the nearest edge within reach, of equals the first."""
    near = near_edges(points, point_id, areas, area_id, reach_m)
    return near.groupBy("point").agg(F.min(F.struct("metres", "area")).alias("b")).select("point", F.col("b.area").alias("area"), F.col("b.metres").alias("metres"))
