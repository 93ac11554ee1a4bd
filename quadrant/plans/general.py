"""Queries of the general data operators: neighbours and regions, and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.operators.packed_fields import three_part, unpacked
from quadrant.operators.voronoi_join import Near, Within, joined_places, voronoi_join
from quadrant.sources.tables import table


NEAR = [Near("amenity_lamp", "amenity", "lamp", 15), Near("amenity_label", "amenity", "label", 40), Near("amenity_amenity", "amenity", "amenity", 8)]


def _points(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str]]:
    named = {"amenity": ("amenities", "amenity_id"), "label": ("labels", "label_id"), "lamp": ("lamps", "lamp_id")}
    return {name: (table(spark, folder, source, key, "lon", "lat"), key) for name, (source, key) in named.items()}


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of amenities, and the campus outlines that contain amenities, labels and lamps."""
    points = _points(spark, folder)
    campus = {"campus": (table(spark, folder, "campus_boundary", "boundary_id", "rings"), "boundary_id")}
    return voronoi_join(spark, points, NEAR, campus, [Within(f"{name}_campus", name, "campus") for name in points])


def p3_places(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbours of p3_found between places with their numbers of points, so that copies of one place do not multiply."""
    return joined_places(spark, _points(spark, folder), NEAR)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every listing of a section card that has campus, building and room."""
    cards = table(spark, folder, "section_cards", "card_id", "building")
    return three_part(cards, "card_id", "building", ("campus", "building", "room")).withColumnRenamed("id", "card_id")


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of all cells by their place in the cell: how many, and how many are blank."""
    values = unpacked(table(spark, folder, "section_cards", "card_id", "building"), "card_id", "building")
    return values.groupBy("at").agg(F.count(F.lit(1)).alias("found"), F.count(F.when(F.col("value") == "", 1)).alias("blank"))


QUERIES = {"p3_found": p3_found, "p3_places": p3_places, "p5_found": p5_found, "p5_values": p5_values}

_DISTANCE = """2 * 6371008.8 * asin(least(1.0, sqrt(
    pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""

_BOXED = "b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.002 AND a.lon + 0.002"

ORACLES = {
    "p3_found": f"""
WITH p AS (
  SELECT 'amenity' AS kind, amenity_id AS id, lon, lat FROM amenities
  UNION ALL SELECT 'label', label_id, lon, lat FROM labels
  UNION ALL SELECT 'lamp', lamp_id, lon, lat FROM lamps),
u AS (SELECT * FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
ring AS (SELECT boundary_id, unnest(range(1, len(rings) + 1)) AS r, rings FROM campus_boundary),
vertex AS (SELECT boundary_id, r, rings[r] AS v, unnest(range(1, len(rings[r]))) AS i FROM ring),
edge AS (SELECT boundary_id, r, v[i].lon AS x1, v[i].lat AS y1, v[i + 1].lon AS x2, v[i + 1].lat AS y2 FROM vertex),
box AS (SELECT boundary_id, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM edge WHERE r = 1 GROUP BY boundary_id),
boxed AS (SELECT u.kind, u.id, u.lon, u.lat, box.boundary_id FROM u JOIN box ON u.lon BETWEEN w AND e AND u.lat BETWEEN s AND n),
parity AS (
  SELECT kind, id, boxed.boundary_id, r, count(*) FILTER (WHERE (lat < y1) <> (lat < y2) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) % 2 AS odd
  FROM boxed JOIN edge ON edge.boundary_id = boxed.boundary_id GROUP BY kind, id, boxed.boundary_id, r)
SELECT 'amenity_lamp' AS rel, a.id AS point_id, b.id AS other_id FROM u a JOIN u b ON {_BOXED}
  WHERE a.kind = 'amenity' AND b.kind = 'lamp' AND {_DISTANCE} <= 15
UNION ALL SELECT 'amenity_label', a.id, b.id FROM u a JOIN u b ON {_BOXED}
  WHERE a.kind = 'amenity' AND b.kind = 'label' AND {_DISTANCE} <= 40
UNION ALL SELECT 'amenity_amenity', a.id, b.id FROM u a JOIN u b ON {_BOXED}
  WHERE a.kind = 'amenity' AND b.kind = 'amenity' AND a.id < b.id AND {_DISTANCE} <= 8
UNION ALL SELECT kind || '_campus', id, boundary_id FROM parity GROUP BY kind, id, boundary_id
  HAVING sum(CASE WHEN r = 1 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN r > 1 THEN odd ELSE 0 END) = 0""",
    "p3_places": f"""
WITH p AS (
  SELECT 'amenity' AS kind, amenity_id AS i, lon, lat FROM amenities
  UNION ALL SELECT 'label', label_id, lon, lat FROM labels
  UNION ALL SELECT 'lamp', lamp_id, lon, lat FROM lamps),
u AS (SELECT kind, lon, lat, min(i) AS id, count(*) AS n FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY kind, lon, lat)
SELECT 'amenity_lamp' AS rel, a.id AS place_id, b.id AS other_id, a.n AS points, b.n AS others FROM u a JOIN u b ON {_BOXED}
  WHERE a.kind = 'amenity' AND b.kind = 'lamp' AND {_DISTANCE} <= 15
UNION ALL SELECT 'amenity_label', a.id, b.id, a.n, b.n FROM u a JOIN u b ON {_BOXED}
  WHERE a.kind = 'amenity' AND b.kind = 'label' AND {_DISTANCE} <= 40
UNION ALL SELECT 'amenity_amenity', a.id, b.id, a.n, b.n FROM u a JOIN u b ON {_BOXED}
  WHERE a.kind = 'amenity' AND b.kind = 'amenity' AND (a.id < b.id OR (a.id = b.id AND a.n > 1)) AND {_DISTANCE} <= 8""",
}
