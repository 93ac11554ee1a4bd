"""Spatial queries over positions that are derived from integer keys, and over the campus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions import geo
from quadrant.operators.nearest import nearest_join, nearest_within, within_join, without_near
from quadrant.operators.voronoi_join import Within, voronoi_join
from quadrant.sources.tables import table

REACH_M = 300.0


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = geo.key_position(F.col("c_custkey"))
    return table(spark, folder, "customer", "c_custkey").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = geo.key_position(F.col("s_suppkey") * 7919 + 4001)
    return table(spark, folder, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", "s_nationkey", lon.alias("lon"), lat.alias("lat"))


def snap_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest supplier of every customer."""
    found = nearest_join(_customers(spark, folder), "c_custkey", _suppliers(spark, folder), "s_suppkey")
    return found.select(F.col("query_id").alias("c_custkey"), F.col("target_id").alias("s_suppkey"), F.round("metres", 4).alias("metres"))


def snap_status(spark: SparkSession, folder: str) -> DataFrame:
    """snap_nearest with whether the supplier is within reach."""
    return snap_nearest(spark, folder).withColumn("status", F.when(F.col("metres") <= REACH_M, "ok").otherwise("unreachable"))


def nearest_instance(spark: SparkSession, folder: str) -> DataFrame:
    """Of each nation's suppliers, the one nearest to the first customer of that nation."""
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    lon, lat = geo.key_position(F.col("c_custkey"))
    asked = customers.select("c_nationkey", "c_custkey", lon.alias("x"), lat.alias("y"))
    rows = asked.join(_suppliers(spark, folder), F.col("c_nationkey") == F.col("s_nationkey"))
    metres = F.round(geo.great_circle_m(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")), 4)
    best = rows.groupBy("c_nationkey", "c_custkey").agg(F.min(F.struct(metres.alias("metres"), "s_suppkey")).alias("b"))
    return best.select("c_nationkey", "c_custkey", F.col("b.s_suppkey").alias("s_suppkey"), F.col("b.metres").alias("metres"))


def within_count(spark: SparkSession, folder: str) -> DataFrame:
    """How many suppliers are within 250 m of each customer that has any."""
    pairs = within_join(_customers(spark, folder), "c_custkey", _suppliers(spark, folder), "s_suppkey", 250)
    return pairs.groupBy(F.col("query_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("suppliers"))


def within_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without a supplier within 100 m."""
    return without_near(_customers(spark, folder), "c_custkey", _suppliers(spark, folder), "s_suppkey", 100).select("c_custkey")


def bounded_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest lamp of each amenity, if it is at most 25 m away."""
    found = nearest_within(table(spark, folder, "amenities", "amenity_id", "lon", "lat"), "amenity_id", table(spark, folder, "lamps", "lamp_id", "lon", "lat"), "lamp_id", 25)
    return found.select(F.col("query_id").alias("amenity_id"), F.col("target_id").alias("lamp_id"), F.round("metres", 4).alias("metres"))


def drawn_or_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Listed amenities that no drawn one of their kind is within 25 m of, by kind: the rest is listed twice."""
    rows = table(spark, folder, "amenities", "amenity_id", "kind", "source", "lon", "lat").filter("kind is not null")
    listed, drawn = rows.filter("source = 'locations'"), rows.filter("source = 'artwork'")
    pairs = within_join(listed, "amenity_id", drawn, "amenity_id", 25)
    kinds = rows.select(F.col("amenity_id"), "kind")
    same = pairs.join(kinds.withColumnsRenamed({"amenity_id": "query_id", "kind": "k1"}), "query_id").join(kinds.withColumnsRenamed({"amenity_id": "target_id", "kind": "k2"}), "target_id").filter("k1 = k2")
    left = listed.join(same.select(F.col("query_id").alias("amenity_id")).distinct(), "amenity_id", "left_anti")
    return left.groupBy("kind").agg(F.count(F.lit(1)).alias("listed_only"))


def _contained(spark: SparkSession, folder: str) -> DataFrame:
    points = {"a": (table(spark, folder, "amenities", "amenity_id", "lon", "lat"), "amenity_id")}
    regions = {"c": (table(spark, folder, "campus_boundary", "boundary_id", "rings"), "boundary_id")}
    return voronoi_join(spark, points, [], regions, [Within("in", "a", "c")]).select(F.col("point_id").alias("amenity_id"), F.col("other_id").alias("boundary_id"))


def contains_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first campus outline, by id, that contains each amenity."""
    return _contained(spark, folder).groupBy("amenity_id").agg(F.min("boundary_id").alias("boundary_id"))


def smallest_containing(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest campus outline that contains each amenity."""
    areas = table(spark, folder, "campus_boundary", "boundary_id", "rings").select("boundary_id", F.round(geo.polygon_area(F.col("rings")) * 1e9, 3).alias("area"))
    best = _contained(spark, folder).join(areas, "boundary_id").groupBy("amenity_id").agg(F.min(F.struct("area", "boundary_id")).alias("b"))
    return best.select("amenity_id", F.col("b.boundary_id").alias("boundary_id"))


def campus_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Area, centroid, box and corners of every campus outline, in millionths of a degree."""
    rings = F.col("rings")
    box = geo.ring_box(rings[0])
    centre = geo.ring_centroid(rings[0])
    rows = table(spark, folder, "campus_boundary", "boundary_id", "rings").select("boundary_id", rings, box.alias("box"), centre.alias("c"), geo.polygon_area(rings).alias("a"))
    micro = lambda c: F.round(c * 1e6, 1)
    return rows.select(
        "boundary_id", F.round(F.col("a") * 1e9, 2).alias("area"), micro(F.col("c.lon")).alias("lon"), micro(F.col("c.lat")).alias("lat"), micro(F.col("box.east") - F.col("box.west")).alias("width"), micro(F.col("box.north") - F.col("box.south")).alias("height"), F.size(F.col("rings")[0]).cast("long").alias("corners")
    )


def vertex_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct positions of order lines, each with the first line that has it."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    return rows.groupBy(((F.col("l_suppkey") * 7919) % 10007).alias("x"), ((F.col("l_suppkey") * 104729) % 9973).alias("y")).agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"), F.count(F.lit(1)).alias("uses")).select("x", "y", F.col("f.l_orderkey").alias("first_order"), F.col("f.l_linenumber").alias("first_line"), "uses")


def vertex_degree(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices of the part-supplier graph with three edges and more, and how many they have."""
    edges = table(spark, folder, "lineitem", "l_partkey", "l_suppkey").distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("key")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("key")))).alias("v"))
    return ends.groupBy("v.kind", "v.key").agg(F.count(F.lit(1)).alias("degree")).filter("degree >= 3")


def clip_to_box(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of customers' way to their next customer that lie in the middle of the map, as shares of the way."""
    rows = _customers(spark, folder).join(_customers(spark, folder).select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "c_custkey")
    t0, t1 = geo.clip_to_box(F.col("lon"), F.col("lat"), F.col("x2"), F.col("y2"), -121.355, 38.64, -121.345, 38.65)
    return rows.select("c_custkey", F.round(t0, 6).alias("t0"), F.round(t1, 6).alias("t1")).filter("t0 is not null and t1 is not null")


def extent(spark: SparkSession, folder: str) -> DataFrame:
    """Bounding box of the usable lamps."""
    rows = table(spark, folder, "lamps", "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)")
    return rows.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def lamp_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Lamps per thousandth of a degree, with the densest cell of each row of the grid."""
    cells = table(spark, folder, "lamps", "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90").groupBy(F.floor(F.col("lon") * 1000).alias("ix"), F.floor(F.col("lat") * 1000).alias("iy")).agg(F.count(F.lit(1)).alias("lamps"))
    w = Window.partitionBy("iy").orderBy(F.desc("lamps"), "ix")
    return cells.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


QUERIES = {f.__name__: f for f in (snap_nearest, snap_status, nearest_instance, within_count, within_anti, bounded_nearest, drawn_or_listed, contains_first, smallest_containing, campus_shapes, vertex_dedupe, vertex_degree, clip_to_box, extent, lamp_grid)}

_POINT = "(-121.36 + CAST(({k} * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.02 AS DOUBLE)) AS lon, (38.635 + CAST(({k} * 104729) % 9973 AS DOUBLE) / CAST(9973 AS DOUBLE) * CAST(0.02 AS DOUBLE)) AS lat"
_METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))".format(a="a", b="b")
_CUSTOMERS = f"a AS (SELECT c_custkey, {_POINT.format(k='c_custkey')} FROM customer)"
_SUPPLIERS = f"b AS (SELECT s_suppkey, s_nationkey, {_POINT.format(k='(s_suppkey * 7919 + 4001)')} FROM supplier)"
_PAIRS = f"WITH {_CUSTOMERS}, {_SUPPLIERS}, p AS (SELECT c_custkey, s_suppkey, {_METRES} AS metres FROM a CROSS JOIN b)"
_NEAREST = "SELECT c_custkey, s_suppkey, round(metres, 4) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY metres, s_suppkey) AS rn FROM p) WHERE rn = 1"
_INSIDE = """
WITH u AS (SELECT amenity_id, lon, lat FROM amenities WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
ring AS (SELECT boundary_id, unnest(range(1, len(rings) + 1)) AS r, rings FROM campus_boundary),
vertex AS (SELECT boundary_id, r, rings[r] AS v, unnest(range(1, len(rings[r]))) AS i FROM ring),
edge AS (SELECT boundary_id, r, v[i].lon AS x1, v[i].lat AS y1, v[i + 1].lon AS x2, v[i + 1].lat AS y2, v[1].lon AS x0, v[1].lat AS y0 FROM vertex),
area AS (SELECT boundary_id, r, sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS a FROM edge GROUP BY boundary_id, r),
size AS (SELECT boundary_id, sum(CASE WHEN r = 1 THEN abs(a) ELSE -abs(a) END) AS a FROM area GROUP BY boundary_id),
parity AS (
  SELECT amenity_id, boundary_id, r, count(*) FILTER (WHERE (lat < y1) <> (lat < y2) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) % 2 AS odd
  FROM u JOIN edge ON lon BETWEEN x1 - 0.05 AND x1 + 0.05 AND lat BETWEEN y1 - 0.05 AND y1 + 0.05 GROUP BY amenity_id, boundary_id, r),
inside AS (SELECT amenity_id, boundary_id FROM parity GROUP BY amenity_id, boundary_id
  HAVING sum(CASE WHEN r = 1 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN r > 1 THEN odd ELSE 0 END) = 0)"""

ORACLES = {
    "snap_nearest": f"{_PAIRS} {_NEAREST}",
    "snap_status": f"{_PAIRS} SELECT *, CASE WHEN metres <= 300 THEN 'ok' ELSE 'unreachable' END AS status FROM ({_NEAREST})",
    "nearest_instance": f"""WITH f AS (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1),
a AS (SELECT c_nationkey, c_custkey, {_POINT.format(k="c_custkey")} FROM f), {_SUPPLIERS},
p AS (SELECT c_nationkey, c_custkey, s_suppkey, round({_METRES}, 4) AS metres FROM a JOIN b ON c_nationkey = s_nationkey)
SELECT c_nationkey, c_custkey, s_suppkey, metres FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY metres, s_suppkey) AS rn FROM p) WHERE rn = 1""",
    "within_count": f"{_PAIRS} SELECT c_custkey, count(*) AS suppliers FROM p WHERE metres <= 250 GROUP BY 1",
    "within_anti": f"{_PAIRS} SELECT c_custkey FROM p GROUP BY 1 HAVING min(metres) > 100",
    "bounded_nearest": f"""WITH a AS (SELECT amenity_id, lon, lat FROM amenities WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
b AS (SELECT lamp_id, lon, lat FROM lamps WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
p AS (SELECT amenity_id, lamp_id, {_METRES} AS metres FROM a JOIN b ON b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.001 AND a.lon + 0.001)
SELECT amenity_id, lamp_id, round(metres, 4) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY amenity_id ORDER BY metres, lamp_id) AS rn FROM p) WHERE rn = 1 AND metres <= 25""",
    "drawn_or_listed": f"""WITH u AS (SELECT amenity_id, kind, source, lon, lat FROM amenities WHERE kind IS NOT NULL),
a AS (SELECT * FROM u WHERE source = 'locations'), b AS (SELECT * FROM u WHERE source = 'artwork' AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
h AS (SELECT DISTINCT a.amenity_id FROM a JOIN b ON a.kind = b.kind AND b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.001 AND a.lon + 0.001
  WHERE a.lon BETWEEN -180 AND 180 AND a.lat BETWEEN -90 AND 90 AND {_METRES} <= 25)
SELECT kind, count(*) AS listed_only FROM a WHERE amenity_id NOT IN (SELECT amenity_id FROM h) GROUP BY kind""",
    "contains_first": f"{_INSIDE} SELECT amenity_id, min(boundary_id) AS boundary_id FROM inside GROUP BY 1",
    "smallest_containing": f"{_INSIDE} SELECT amenity_id, boundary_id FROM (SELECT amenity_id, i.boundary_id, row_number() OVER (PARTITION BY amenity_id ORDER BY round(a * 1e9, 3), i.boundary_id) AS rn FROM inside i JOIN size s ON s.boundary_id = i.boundary_id) WHERE rn = 1",
    "campus_shapes": f"""{_INSIDE.split("parity AS")[0].rstrip().rstrip(",")},
c AS (SELECT boundary_id, any_value(x0) AS x0, any_value(y0) AS y0, sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS k,
  sum((x1 + x2 - 2 * x0) * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) AS sx, sum((y1 + y2 - 2 * y0) * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) AS sy,
  max(x1) - min(x1) AS w, max(y1) - min(y1) AS h, count(*) + 1 AS n FROM edge WHERE r = 1 GROUP BY boundary_id)
SELECT c.boundary_id, round(a * 1e9, 2) AS area, round((x0 + sx / (3 * k)) * 1e6, 1) AS lon, round((y0 + sy / (3 * k)) * 1e6, 1) AS lat, round(w * 1e6, 1) AS width, round(h * 1e6, 1) AS height, n AS corners
FROM c JOIN size s ON s.boundary_id = c.boundary_id""",
    "vertex_dedupe": """SELECT x, y, l_orderkey AS first_order, l_linenumber AS first_line, uses FROM (
SELECT (l_suppkey * 7919) % 10007 AS x, (l_suppkey * 104729) % 9973 AS y, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY (l_suppkey * 7919) % 10007, (l_suppkey * 104729) % 9973) AS uses,
row_number() OVER (PARTITION BY (l_suppkey * 7919) % 10007, (l_suppkey * 104729) % 9973 ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
    "vertex_degree": """WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), v AS (SELECT 'part' AS kind, l_partkey AS key FROM e UNION ALL SELECT 'supplier', l_suppkey FROM e)
SELECT kind, key, count(*) AS degree FROM v GROUP BY kind, key HAVING count(*) >= 3""",
    "clip_to_box": f"""WITH {_CUSTOMERS}, s AS (SELECT a.c_custkey, a.lon AS x1, a.lat AS y1, n.lon - a.lon AS dx, n.lat - a.lat AS dy FROM a JOIN a n ON n.c_custkey = a.c_custkey + 1),
q AS (SELECT c_custkey, unnest([-dx, dx, -dy, dy]) AS p, unnest([x1 + 121.355, -121.345 - x1, y1 - 38.64, 38.65 - y1]) AS q FROM s),
t AS (SELECT c_custkey, greatest(0.0, coalesce(max(CASE WHEN p < 0 THEN q / p END), 0.0)) AS t0, least(1.0, coalesce(min(CASE WHEN p > 0 THEN q / p END), 1.0)) AS t1, bool_or(p = 0 AND q < 0) AS o FROM q GROUP BY 1)
SELECT c_custkey, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM t WHERE NOT o AND t0 <= t1""",
    "extent": "SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM lamps WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0)",
    "lamp_grid": """WITH c AS (SELECT CAST(floor(lon * 1000) AS BIGINT) AS ix, CAST(floor(lat * 1000) AS BIGINT) AS iy, count(*) AS lamps FROM lamps WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY 1, 2)
SELECT ix, iy, lamps FROM (SELECT *, row_number() OVER (PARTITION BY iy ORDER BY lamps DESC, ix) AS rn FROM c) WHERE rn = 1""",
}

#: WITH clauses up to ``inside`` (point and outline), for other modules' SQL; and the clause of the outlines' sizes.
INSIDE_SQL = _INSIDE
AREA_SQL = "sized AS (SELECT boundary_id, round(a * 1e9, 3) AS size FROM size)"
