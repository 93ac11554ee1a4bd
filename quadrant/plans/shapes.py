"""Geometry queries over the campus outlines and the points on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions import geo, shapes
from quadrant.sources.tables import table


def _outlines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "campus_boundary", "boundary_id", "rings").filter("size(rings) > 0").withColumn("ring", F.get("rings", F.lit(0))).filter("size(ring) > 3")


def _micro(value: Column) -> Column:
    return F.round(value * 1e6, 1)


def outline_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Vertex mean, centroid, extent, longest edge, corners and winding of every outline."""
    ring, box = F.col("ring"), shapes.extent(F.col("rings"))
    rows = _outlines(spark, folder).select("boundary_id", "ring", shapes.vertex_mean(ring).alias("m"), shapes.centroid(ring).alias("c"), box.alias("x"), shapes.longest_edge_deg(ring).alias("longest"), F.size(shapes.sharp_corners(ring)).alias("sharp"), (geo.ring_area(shapes.wound(ring, False)) <= 0).alias("clockwise"))
    return rows.select("boundary_id", F.round("m.lon", 6).alias("mean_lon"), F.round("m.lat", 6).alias("mean_lat"), _micro(F.col("c.lon")).alias("lon"), _micro(F.col("c.lat")).alias("lat"), F.round("x.half_width", 3).alias("half_width"), F.round("x.half_height", 3).alias("half_height"), F.round("longest", 5).alias("longest"), "sharp", "clockwise")


def outline_poles(spark: SparkSession, folder: str) -> DataFrame:
    """The pole of inaccessibility of every outline and how deep it lies."""
    rows = _outlines(spark, folder).select("boundary_id", shapes.inner_pole("ring").alias("p"))
    return rows.select("boundary_id", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"), F.round("p.radius", 3).alias("radius"))


def _depths(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids of all outlines with their signed distances to their own ring."""
    rows = _outlines(spark, folder).select("boundary_id", "rings", "ring", shapes.centroid(F.col("ring")).alias("c"))
    return rows.select("boundary_id", F.round(shapes.signed_m(F.col("c.lon"), F.col("c.lat"), F.col("ring")), 3).alias("depth"), F.round(shapes.to_area_m(F.col("c.lon"), F.col("c.lat"), F.col("rings")), 3).alias("to_area"), F.round(shapes.to_area_m(F.col("c.lon") + 0.05, F.col("c.lat"), F.col("rings")), 3).alias("from_afar"))


def outline_depth(spark: SparkSession, folder: str) -> DataFrame:
    """How deep each outline's centroid lies in it, and how far it and a point to the east are from its area."""
    return _depths(spark, folder)


def _ways(spark: SparkSession, folder: str) -> DataFrame:
    """For each outline, a line of four points that crosses it from beyond its box."""
    box = geo.ring_box(F.col("ring"))
    rows = _outlines(spark, folder).withColumn("b", box).select("boundary_id", "ring", (F.col("b.west")).alias("w"), F.col("b.east").alias("e"), F.col("b.south").alias("s"), F.col("b.north").alias("n"))
    x = lambda t: F.col("w") + t * (F.col("e") - F.col("w"))
    y = lambda t: F.col("s") + t * (F.col("n") - F.col("s"))
    corner = [(-0.13, 0.31), (0.47, 0.53), (0.61, 0.41), (1.17, 0.73)]
    return rows.select("boundary_id", "ring", F.array(*[shapes.point(x(a), y(b)) for a, b in corner]).alias("line"))


def _length(line: Column) -> Column:
    return F.element_at(shapes.along_line(line), -1)


def clipped_ways(spark: SparkSession, folder: str) -> DataFrame:
    """A line across each outline, its parts inside and outside: numbers, points and metres; the metres of all parts are the line's."""
    rows = _ways(spark, folder).select("boundary_id", "line", shapes.clipped(F.col("line"), F.col("ring")).alias("i"), shapes.clipped(F.col("line"), F.col("ring"), True).alias("o"))
    metres = lambda parts: F.round(F.aggregate(F.transform(parts, _length), F.lit(0.0), lambda s, x: s + x), 2)
    return rows.select("boundary_id", F.size("i").alias("inside_parts"), F.size(F.flatten("i")).alias("inside_points"), metres(F.col("i")).alias("inside_m"), F.size("o").alias("outside_parts"), metres(F.col("o")).alias("outside_m"), F.round(_length(F.col("line")), 2).alias("line_m"))


def line_feet(spark: SparkSession, folder: str) -> DataFrame:
    """The point of each crossing line that is nearest to the outline's first corner, how far along, and that the line leads there."""
    rows = _ways(spark, folder).withColumn("p", F.get("ring", F.lit(0)))
    found = rows.withColumn("f", shapes.nearest_on_line(F.col("p.lon"), F.col("p.lat"), F.col("line"))).withColumn("again", shapes.point_along(F.col("line"), F.col("f.along")))
    gap = geo.great_circle_m(F.col("f.lon"), F.col("f.lat"), F.col("again.lon"), F.col("again.lat"))
    return found.select("boundary_id", F.round("f.away", 2).alias("away"), F.round("f.along", 1).alias("along"), (gap < 0.5).alias("found_again"))


def regrouped(spark: SparkSession, folder: str) -> DataFrame:
    """All outlines' rings taken apart and nested again: outlines, holes, and area, which must be as before."""
    rows = _outlines(spark, folder).select("boundary_id", "rings", F.explode(shapes.nested_polygons(F.reverse(F.col("rings")))).alias("polygon"))
    return rows.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("polygons"), F.sum(F.size("polygon") - 1).cast("long").alias("holes"), F.round(F.sum(geo.polygon_area(F.col("polygon"))) * 1e9, 2).alias("area"))


def bay_spines(spark: SparkSession, folder: str) -> DataFrame:
    """Midlines of the boxes around all outlines, drawn as four-cornered bays."""
    b = F.col("b")
    box = F.array(*[shapes.point(b[x], b[y]) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))])
    rows = _outlines(spark, folder).withColumn("b", geo.ring_box(F.col("ring"))).select("boundary_id", shapes.bay_spine(box).alias("s"))
    return rows.select("boundary_id", _micro(F.col("s.a.lon")).alias("lon_a"), _micro(F.col("s.a.lat")).alias("lat_a"), _micro(F.col("s.b.lon")).alias("lon_b"), _micro(F.col("s.b.lat")).alias("lat_b"), F.round("s.width", 1).alias("width"))


def roof_circles(spark: SparkSession, folder: str) -> DataFrame:
    """Roofs drawn as circles of their area: points and area of the ring."""
    rows = table(spark, folder, "roofs", "roof_id", "area_m2").filter("area_m2 > 0")
    r = F.sqrt(F.col("area_m2") / F.lit(3.141592653589793))
    ring = shapes.circle_ring(F.lit(0.0), F.lit(0.0), r, r)
    return rows.select("roof_id", F.size(ring).alias("points"), F.round(geo.ring_area(ring), 3).alias("area"))


FEET_A_TICK = 4.6 * 4 * 0.2


def simulated_walks(spark: SparkSession, folder: str) -> DataFrame:
    """Walks simulated along the crossing lines, a position each fifth of a second at four times walking speed, the last at the end: how many, and that they end there."""
    tick = FEET_A_TICK / geo.FEET_PER_METRE
    rows = _ways(spark, folder).withColumn("total", _length(F.col("line"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / tick).cast("int"))))
    at = rows.select("boundary_id", "total", "i", F.element_at("line", -1).alias("end"), shapes.point_along(F.col("line"), F.least(F.col("i") * tick, F.col("total"))).alias("p"))
    gap = geo.great_circle_m(F.col("p.lon"), F.col("p.lat"), F.col("end.lon"), F.col("end.lat"))
    return at.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("ticks"), (F.min_by(gap, -F.col("i")) < 0.01).alias("arrives"), F.round(F.max("total"), 2).alias("metres"))


QUERIES = {f.__name__: f for f in (simulated_walks, outline_measures, outline_poles, outline_depth, clipped_ways, line_feet, regrouped, bay_spines, roof_circles)}

_EDGES = """WITH o AS (SELECT boundary_id, rings[1] AS v, rings FROM campus_boundary WHERE len(rings) > 0 AND len(rings[1]) > 3),
i AS (SELECT boundary_id, v, unnest(range(1, len(v))) AS i FROM o),
e AS (SELECT boundary_id, i, v[1].lon AS x0, v[1].lat AS y0, v[i].lon AS x1, v[i].lat AS y1, v[i + 1].lon AS x2, v[i + 1].lat AS y2, len(v) - 1 AS n,
  v[CASE WHEN i = 1 THEN len(v) - 1 ELSE i - 1 END].lon AS xp, v[CASE WHEN i = 1 THEN len(v) - 1 ELSE i - 1 END].lat AS yp FROM i)"""
_CENTRES = """s AS (SELECT boundary_id, any_value(x0) AS x0, any_value(y0) AS y0, sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS k,
  sum((x1 + x2 - 2 * x0) * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) AS sx, sum((y1 + y2 - 2 * y0) * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) AS sy,
  round(avg(x1), 7) AS mx, round(avg(y1), 7) AS my FROM e GROUP BY boundary_id),
c AS (SELECT boundary_id, x0 + sx / (3 * k) AS cx, y0 + sy / (3 * k) AS cy, mx, my FROM s)"""
_KX, _KY = "(111320.0 * cos(radians(38.6547)))", "111320.0"


def _away(x: str, y: str) -> str:
    """Metres from (x, y) to the edge of a row with x1, y1, x2, y2."""
    ax, ay, bx, by = f"(x1 - {x}) * {_KX}", f"(y1 - {y}) * {_KY}", f"(x2 - {x}) * {_KX}", f"(y2 - {y}) * {_KY}"
    t = f"greatest(0.0, least(1.0, coalesce(-({ax} * ({bx} - {ax}) + {ay} * ({by} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0), 0.0)))"
    return f"sqrt(pow({ax} + {t} * ({bx} - {ax}), 2) + pow({ay} + {t} * ({by} - {ay}), 2))"


_CORNERS = [(-0.13, 0.31), (0.47, 0.53), (0.61, 0.41), (1.17, 0.73)]


def _step(i: int) -> str:
    (a, b), (c, d) = _CORNERS[i], _CORNERS[i + 1]
    x1, y1, x2, y2 = f"(w + {a} * (e - w))", f"(s + {b} * (n - s))", f"(w + {c} * (e - w))", f"(s + {d} * (n - s))"
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


ORACLES = {
    "simulated_walks": f"""WITH p AS (SELECT boundary_id, p.lon AS lon, p.lat AS lat FROM (SELECT boundary_id, unnest(rings[1]) AS p FROM campus_boundary WHERE len(rings) > 0 AND len(rings[1]) > 3)),
b AS (SELECT boundary_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM p GROUP BY boundary_id), l AS (SELECT boundary_id, {_step(0)} + {_step(1)} + {_step(2)} AS m FROM b)
SELECT boundary_id, CAST(ceil(m / ({FEET_A_TICK} / 3.28084)) AS BIGINT) AS ticks, true AS arrives, round(m, 2) AS metres FROM l""",
    "outline_measures": f"""{_EDGES}, {_CENTRES},
p AS (SELECT boundary_id, p.lon AS lon, p.lat AS lat FROM (SELECT boundary_id, unnest(flatten(rings)) AS p FROM o)),
x AS (SELECT boundary_id, (max(lon) - min(lon)) / 2 * 86900 AS hw, (max(lat) - min(lat)) / 2 * 111132 AS hh FROM p GROUP BY boundary_id),
l AS (SELECT boundary_id, i, (x2 - x1) * cos(radians(y0)) AS dx, y2 - y1 AS dy, abs(degrees(atan2(y2 - y1, x2 - x1) - atan2(y1 - yp, x1 - xp))) AS raw FROM e),
g AS (SELECT boundary_id, arg_min(-degrees(atan2(CASE WHEN dx >= 0 THEN dy ELSE -dy END, abs(dx))), {{'l': -sqrt(dx * dx + dy * dy), 'i': i}}) AS longest,
  CAST(count(*) FILTER (WHERE CASE WHEN raw > 180 THEN 360 - raw ELSE raw END >= 25) AS INTEGER) AS sharp FROM l GROUP BY boundary_id)
SELECT c.boundary_id, round(mx, 6) AS mean_lon, round(my, 6) AS mean_lat, round(cx * 1e6, 1) AS lon, round(cy * 1e6, 1) AS lat, round(hw, 3) AS half_width, round(hh, 3) AS half_height, round(longest, 5) AS longest, sharp, true AS clockwise
FROM c JOIN x USING (boundary_id) JOIN g USING (boundary_id)""",
    "outline_depth": f"""{_EDGES}, {_CENTRES},
d AS (SELECT e.boundary_id, min({_away("cx", "cy")}) AS away, count(*) FILTER (WHERE (cy < y1) <> (cy < y2) AND cx < x1 + (cy - y1) / (y2 - y1) * (x2 - x1)) % 2 AS odd FROM e JOIN c USING (boundary_id) GROUP BY e.boundary_id),
r AS (SELECT boundary_id, rings, unnest(range(1, len(rings) + 1)) AS r FROM o), ri AS (SELECT boundary_id, r, rings[r] AS v, unnest(range(1, len(rings[r]))) AS i FROM r),
q AS (SELECT boundary_id, r, v[i].lon AS x1, v[i].lat AS y1, v[i + 1].lon AS x2, v[i + 1].lat AS y2 FROM ri),
h AS (SELECT q.boundary_id, r, min({_away("cx", "cy")}) AS near, min({_away("(cx + 0.05)", "cy")}) AS far, count(*) FILTER (WHERE (cy < y1) <> (cy < y2) AND cx < x1 + (cy - y1) / (y2 - y1) * (x2 - x1)) % 2 AS odd,
  count(*) FILTER (WHERE (cy < y1) <> (cy < y2) AND cx + 0.05 < x1 + (cy - y1) / (y2 - y1) * (x2 - x1)) % 2 AS far_odd FROM q JOIN c USING (boundary_id) GROUP BY q.boundary_id, r),
m AS (SELECT boundary_id, min(near) AS near, min(far) AS far, max(CASE WHEN r = 1 THEN odd END) = 1 AND coalesce(max(CASE WHEN r > 1 THEN odd END), 0) = 0 AS inside,
  max(CASE WHEN r = 1 THEN far_odd END) = 1 AND coalesce(max(CASE WHEN r > 1 THEN far_odd END), 0) = 0 AS far_inside FROM h GROUP BY boundary_id)
SELECT boundary_id, round(CASE WHEN odd = 1 THEN away ELSE -away END, 3) AS depth, CASE WHEN inside THEN 0.0 ELSE round(near, 3) END AS to_area, CASE WHEN far_inside THEN 0.0 ELSE round(far, 3) END AS from_afar FROM d JOIN m USING (boundary_id)""",
    "regrouped": """WITH o AS (SELECT boundary_id, rings FROM campus_boundary WHERE len(rings) > 0 AND len(rings[1]) > 3), r AS (SELECT boundary_id, rings, unnest(range(1, len(rings) + 1)) AS r FROM o),
i AS (SELECT boundary_id, r, rings[r] AS v, unnest(range(1, len(rings[r]))) AS i FROM r),
a AS (SELECT boundary_id, r, abs(sum((v[i].lon - v[1].lon) * (v[i + 1].lat - v[1].lat) - (v[i + 1].lon - v[1].lon) * (v[i].lat - v[1].lat))) / 2 AS a FROM i GROUP BY boundary_id, r)
SELECT boundary_id, CAST(1 AS BIGINT) AS polygons, CAST(count(*) - 1 AS BIGINT) AS holes, round(sum(CASE WHEN r = 1 THEN a ELSE -a END) * 1e9, 2) AS area FROM a GROUP BY boundary_id""",
    "bay_spines": """WITH p AS (SELECT boundary_id, p.lon AS lon, p.lat AS lat FROM (SELECT boundary_id, unnest(rings[1]) AS p FROM campus_boundary WHERE len(rings) > 0 AND len(rings[1]) > 3)),
b AS (SELECT boundary_id, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM p GROUP BY boundary_id),
d AS (SELECT *, (e - w) * 86940 AS across, (n - s) * 110980 AS up FROM b)
SELECT boundary_id, round(CASE WHEN across < up THEN (w + e) / 2 ELSE e END * 1e6, 1) AS lon_a, round(CASE WHEN across < up THEN s ELSE (s + n) / 2 END * 1e6, 1) AS lat_a,
round(CASE WHEN across < up THEN (w + e) / 2 ELSE w END * 1e6, 1) AS lon_b, round(CASE WHEN across < up THEN n ELSE (s + n) / 2 END * 1e6, 1) AS lat_b, round(least(across, up), 1) AS width FROM d""",
    "roof_circles": "SELECT roof_id, 33 AS points, round(area_m2 / pi() * 16 * sin(2 * pi() / 32), 3) AS area FROM roofs WHERE area_m2 > 0",
}
