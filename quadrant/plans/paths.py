"""Routes as ordered vertices: turns, legs, cumulative distance, progress along a line; units and daylight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions import geo, solar, units
from quadrant.sources.tables import table


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as vertices of a path, in order of time; positions come from the event's key."""
    lon, lat = geo.key_position(F.col("event_id"))
    rows = table(spark, folder, "events", "event_id", "user_id", "ts").select("user_id", "ts", "event_id", lon.alias("lon"), lat.alias("lat"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("*", F.lag("lon").over(w).alias("lon0"), F.lag("lat").over(w).alias("lat0"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"), F.row_number().over(w).alias("idx"))


def _turn() -> Column:
    incoming = geo.bearing_deg(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    outgoing = geo.bearing_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return geo.turn_deg(incoming, outgoing)


def turn_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of all paths by kind."""
    rows = _steps(spark, folder).filter("lon0 is not null and lon2 is not null").select(units.turn_kind(_turn()).alias("turn"))
    return rows.groupBy("turn").agg(F.count(F.lit(1)).alias("turns"))


def cumulative_feet(spark: SparkSession, folder: str) -> DataFrame:
    """Distance walked up to each vertex of each path, 0 at the first."""
    step = F.coalesce(geo.great_circle_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), F.lit(0.0)) * geo.FEET_PER_METRE
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return _steps(spark, folder).withColumn("step", step).select("user_id", F.col("idx").cast("long").alias("idx"), F.round(F.sum("step").over(w), 3).alias("feet"))


def maneuvers(spark: SparkSession, folder: str) -> DataFrame:
    """Legs between turns: start, one per vertex that is no straight, arrival; each with its rounded length."""
    step = F.coalesce(geo.great_circle_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), F.lit(0.0)) * geo.FEET_PER_METRE
    kind = F.when(F.col("lon0").isNull(), "depart").when(F.col("lon2").isNull(), "arrive").otherwise(units.turn_kind(_turn()))
    rows = _steps(spark, folder).select("user_id", "idx", step.alias("step"), kind.alias("kind"))
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    legs = rows.withColumn("leg", F.sum(F.when(F.col("kind") != "straight", 1).otherwise(0)).over(w))
    grouped = legs.groupBy("user_id", "leg").agg(F.min(F.struct("idx", "kind")).alias("f"), F.sum("step").alias("feet"))
    return grouped.select("user_id", F.col("leg").cast("long").alias("leg"), F.col("f.kind").alias("kind"), units.half_up(F.round(F.col("feet"), 6)).cast("long").alias("feet"))


def nice_feet(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals, taken as feet, as a walker would be told them, and as walking time."""
    feet = F.col("o_totalprice") / 10
    return table(spark, folder, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", units.nice_feet(feet).alias("said"), units.walk_label(feet / geo.FEET_PER_METRE).alias("walk"))


def light_preset(spark: SparkSession, folder: str) -> DataFrame:
    """Events by the light outside when they happened."""
    elevation, hour = solar.sun_elevation(F.col("ts"), F.lit(-121.35), F.lit(38.65))
    rows = table(spark, folder, "events", "ts").select(F.round(elevation, 6).alias("e"), F.round(hour, 6).alias("h"))
    return rows.groupBy(solar.light_preset(F.col("e"), F.col("h")).alias("preset")).agg(F.count(F.lit(1)).alias("events"), F.round(F.max("e"), 3).alias("highest"), F.round(F.min("e"), 3).alias("lowest"))


STEPS = [0.0, 100.0, 260.0, 300.0, 420.0, 700.0]


def nav_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The step each walker has reached on a line of six steps: it never goes back, so it is a running maximum."""
    along = F.abs(F.col("value")) * 10 % 700
    reached = F.least(F.lit(len(STEPS) - 1), F.size(F.filter(F.array(*map(F.lit, STEPS)), lambda k: k < F.col("along") + 25)))
    rows = table(spark, folder, "events", "event_id", "user_id", "ts", "value").filter("value is not null").withColumn("along", F.round(along, 6)).withColumn("here", reached)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", F.max("here").over(w).cast("long").alias("step"))


def bearing_hold(spark: SparkSession, folder: str) -> DataFrame:
    """The heading shown at each vertex: that of the last move of more than 300 m."""
    metres = geo.great_circle_m(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    heading = F.when(metres > 300, geo.bearing_deg(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")))
    w = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return _steps(spark, folder).withColumn("b", heading).select("event_id", F.round(F.last("b", ignorenulls=True).over(w), 4).alias("bearing"))


QUERIES = {f.__name__: f for f in (turn_classify, cumulative_feet, maneuvers, nice_feet, light_preset, nav_progress, bearing_hold)}

_AT = "(-121.36 + CAST((event_id * 7919) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) * CAST(0.02 AS DOUBLE)) AS lon, (38.635 + CAST((event_id * 104729) % 9973 AS DOUBLE) / CAST(9973 AS DOUBLE) * CAST(0.02 AS DOUBLE)) AS lat"
_STEPS = f"""WITH e AS (SELECT user_id, ts, event_id, {_AT} FROM events),
s AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, row_number() OVER w AS idx FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _sql_metres(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"


def _sql_bearing(a: str, b: str, c: str, d: str) -> str:
    return f"degrees(atan2(sin(radians({c} - {a})) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians({c} - {a}))))"


_RAW = f"({_sql_bearing('lon', 'lat', 'lon2', 'lat2')} - {_sql_bearing('lon0', 'lat0', 'lon', 'lat')})"
_TURNS = f"""{_STEPS}, b AS (SELECT *, {_RAW} AS raw FROM s), d AS (SELECT *, CASE WHEN raw > 180 THEN raw - 360 WHEN raw < -180 THEN raw + 360 ELSE raw END AS turn FROM b),
t AS (SELECT *, CASE WHEN lon0 IS NULL THEN 'depart' WHEN lon2 IS NULL THEN 'arrive' WHEN abs(turn) < 20 THEN 'straight' WHEN abs(turn) > 150 THEN 'uturn'
  WHEN abs(turn) <= 60 THEN 'slight-' || CASE WHEN turn > 0 THEN 'right' ELSE 'left' END ELSE CASE WHEN turn > 0 THEN 'right' ELSE 'left' END END AS kind FROM d)"""
_FEET = "3.28084"

ORACLES = {
    "turn_classify": f"{_TURNS} SELECT kind AS turn, count(*) AS turns FROM t WHERE kind NOT IN ('depart', 'arrive') GROUP BY 1",
    "cumulative_feet": f"{_STEPS} SELECT user_id, idx, round(sum(coalesce({_sql_metres('lon0', 'lat0', 'lon', 'lat')}, 0.0) * {_FEET}) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 3) AS feet FROM s",
    "maneuvers": f"""{_TURNS}, l AS (SELECT *, sum(CASE WHEN kind <> 'straight' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS leg,
coalesce({_sql_metres('lon', 'lat', 'lon2', 'lat2')}, 0.0) * {_FEET} AS step FROM t)
SELECT user_id, CAST(leg AS BIGINT) AS leg, arg_min(kind, idx) AS kind, CAST(floor(round(sum(step), 6) + 0.5) AS BIGINT) AS feet FROM l GROUP BY user_id, leg""",
    "nice_feet": f"""WITH f AS (SELECT o_orderkey, o_totalprice / 10 AS feet FROM orders), m AS (SELECT *, CAST(greatest(ceil(feet / {_FEET} / 84.0), 1) AS BIGINT) AS minutes, CAST(floor(feet / 5280 * 10 + 0.5) AS BIGINT) AS tenths FROM f)
SELECT o_orderkey, CASE WHEN feet >= 5280 THEN CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) || ' mi'
  WHEN feet < 50 THEN CAST(CAST(greatest(floor(feet / 5 + 0.5) * 5, 0) AS BIGINT) AS VARCHAR) || ' ft' WHEN feet < 500 THEN CAST(CAST(floor(feet / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) || ' ft'
  ELSE CAST(CAST(floor(feet / 50 + 0.5) * 50 AS BIGINT) AS VARCHAR) || ' ft' END AS said,
CASE WHEN minutes < 60 THEN CAST(minutes AS VARCHAR) || ' min' ELSE CAST(minutes // 60 AS VARCHAR) || ' hr' || CASE WHEN minutes % 60 > 0 THEN ' ' || CAST(minutes % 60 AS VARCHAR) || ' min' ELSE '' END END AS walk FROM m""",
    "nav_progress": """WITH a AS (SELECT event_id, user_id, ts, round(fmod(abs(value) * 10, 700), 6) AS along FROM events WHERE value IS NOT NULL),
h AS (SELECT *, least(5, len(list_filter([0.0, 100.0, 260.0, 300.0, 420.0, 700.0], lambda k: k < along + 25))) AS here FROM a)
SELECT event_id, CAST(max(here) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step FROM h""",
    "bearing_hold": f"""{_STEPS}, b AS (SELECT event_id, user_id, idx, CASE WHEN {_sql_metres('lon0', 'lat0', 'lon', 'lat')} > 300 THEN {_sql_bearing('lon0', 'lat0', 'lon', 'lat')} END AS b FROM s)
SELECT event_id, round(last_value(b IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 4) AS bearing FROM b""",
    "light_preset": """WITH t AS (SELECT CAST(epoch_us(ts) AS DOUBLE) AS us FROM events), c AS (SELECT us, (us / 86400000000.0 + 2440587.5 - 2451545.0) / 36525.0 AS t FROM t),
g AS (SELECT us, t, fmod(280.46646 + t * (36000.76983 + t * 0.0003032), 360) AS ml, 357.52911 + t * (35999.05029 - t * 0.0001537) AS ma, 125.04 - 1934.136 * t AS node, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS e FROM c),
l AS (SELECT *, ml + sin(radians(ma)) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(radians(ma * 2)) * (0.019993 - 0.000101 * t) + sin(radians(ma * 3)) * 0.000289 - 0.00569 - sin(radians(node)) * 0.00478 AS lng,
  23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + cos(radians(node)) * 0.00256 AS tilt FROM g),
d AS (SELECT *, asin(sin(radians(tilt)) * sin(radians(lng))) AS decl, pow(tan(radians(tilt / 2)), 2) AS y FROM l),
q AS (SELECT *, (4 * 180 / pi()) * (y * sin(radians(ml * 2)) - e * 2 * sin(radians(ma)) + e * 4 * y * sin(radians(ma)) * cos(radians(ml * 2)) - y * y * 0.5 * sin(radians(ml * 4)) - e * e * 1.25 * sin(radians(ma * 2))) AS eq FROM d),
h AS (SELECT decl, fmod(fmod(us, 86400000000.0) / 60000000.0 + eq + (-121.35) * 4 + 1440, 1440) / 4 - 180 AS ha FROM q),
r AS (SELECT round(degrees(asin(sin(radians(38.65)) * sin(decl) + cos(radians(38.65)) * cos(decl) * cos(radians(ha)))), 6) AS e, round(ha, 6) AS h FROM h)
SELECT CASE WHEN e > 6 THEN 'day' WHEN e > -0.833 THEN CASE WHEN h < 0 THEN 'dawn' ELSE 'dusk' END ELSE 'night' END AS preset, count(*) AS events, round(max(e), 3) AS highest, round(min(e), 3) AS lowest FROM r GROUP BY 1""",
}
