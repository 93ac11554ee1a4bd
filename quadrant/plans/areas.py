"""Joins of points with areas, and what follows from them: rollups, names, contents, anti and semi joins on shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions import geo, shapes
from quadrant.operators import areas
from quadrant.operators.nearest import nearest_join, within_join
from quadrant.plans.spatial import AREA_SQL, INSIDE_SQL
from quadrant.sources.tables import table

#: Metres within which a place outside all areas still counts as in one; within which a plate names a building (not included); of a gate.
PLACE_REACH_M, PLATE_REACH_M, GATE_M = 5.0, 40.0, 12.0
#: Categories of things, the kinds that belong to each, and the icon shown instead of the kind's own.
CATEGORIES = {"water": ["fountain", "shower"], "wheels": ["bike_rack", "bus_stop", "charger"], "rest": ["restroom", "lactation"], "food": ["vending"]}


def _amenities(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "amenities", "amenity_id", "lon", "lat", *more)


def _labels(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "labels", "label_id", "lon", "lat", *more)


def _outlines(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "campus_boundary", "boundary_id", "rings", *more)


def area_or_near(spark: SparkSession, folder: str) -> DataFrame:
    """The outline each amenity lies in, else the nearest within reach of five metres, the later of equals."""
    found = areas.containing_else_near(_amenities(spark, folder), "amenity_id", _outlines(spark, folder), "boundary_id", PLACE_REACH_M)
    return found.select(F.col("point").alias("amenity_id"), F.col("area").alias("boundary_id"), F.round("metres", 3).alias("metres"))


def gate_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Lamps with the outline whose edge is nearest, at most twelve metres away."""
    lamps = table(spark, folder, "lamps", "lamp_id", "lon", "lat")
    found = areas.nearest_edge_within(lamps, "lamp_id", _outlines(spark, folder), "boundary_id", GATE_M)
    return found.select(F.col("point").alias("lamp_id"), F.col("area").alias("boundary_id"), F.round("metres", 3).alias("metres"))


def highlight_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """For each kind of amenity: the outlines that hold some, in order, how many, and how many amenities lie in none."""
    rows = _amenities(spark, folder, "kind").filter("kind is not null and lon is not null and lat is not null")
    held = areas.first_containing(rows, "amenity_id", _outlines(spark, folder), "boundary_id").withColumnRenamed("point", "amenity_id")
    both = rows.join(held, "amenity_id", "left")
    rolled = both.groupBy("kind").agg(F.sort_array(F.collect_set("area")).alias("a"), F.count(F.when(F.col("area").isNull(), 1)).alias("outside"))
    return rolled.select("kind", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("areas"), F.size("a").cast("long").alias("buildings"), "outside")


def category_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Things of each category: amenities by kind and labels whose text names the category, those without a position left out; counts by icon."""
    members = spark.createDataFrame([(c, k) for c, kinds in CATEGORIES.items() for k in kinds], "category string, kind string")
    named = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    amenities = _amenities(spark, folder, "kind").filter("lon is not null and lat is not null").join(F.broadcast(members), "kind").select("category", F.col("kind").alias("icon"))
    labels = _labels(spark, folder, "text").filter("lon is not null and lat is not null and text is not null")
    labels = labels.join(F.broadcast(named), F.lower("text").contains(F.col("category"))).select("category", F.col("category").alias("icon"))
    return amenities.unionByName(labels).groupBy("category", "icon").agg(F.count(F.lit(1)).alias("things"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return _outlines(spark, folder).select(F.col("boundary_id").alias("area"), F.round(geo.polygon_area(F.col("rings")) * 1e9, 3).alias("size"))


def outline_names(spark: SparkSession, folder: str) -> DataFrame:
    """A name for each outline: the first label whose smallest containing outline it is; else the name of the smallest outline that holds its centroid."""
    labels = _labels(spark, folder, "text").filter("text is not null")
    inside = areas.containing(labels, "label_id", _outlines(spark, folder), "boundary_id").withColumnRenamed("point", "label_id")
    smallest = inside.join(_sized(spark, folder), "area").groupBy("label_id").agg(F.min(F.struct("size", "area")).alias("b")).select("label_id", F.col("b.area").alias("area"))
    first = smallest.groupBy("area").agg(F.min("label_id").alias("label_id")).join(labels.select("label_id", "text"), "label_id").select("area", F.col("text").alias("own"))
    outlines = _outlines(spark, folder).select(F.col("boundary_id").alias("area"), shapes.centroid(F.col("rings")[0]).alias("c"))
    centres = outlines.select(F.col("area").alias("centre"), F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
    around = areas.containing(centres, "centre", _outlines(spark, folder), "boundary_id").filter("point <> area").join(_sized(spark, folder), "area").join(first.withColumnRenamed("own", "other"), "area")
    second = around.groupBy(F.col("point").alias("area")).agg(F.min_by("other", F.struct("size", "area")).alias("around"))
    return outlines.select("area").join(first, "area", "left").join(second, "area", "left").select(F.col("area").alias("boundary_id"), F.coalesce("own", "around").alias("name"), F.when(F.col("own").isNotNull(), 1).when(F.col("around").isNotNull(), 2).alias("pass"))


def _metres(a: str, b: str) -> Column:
    return geo.great_circle_m(F.col(f"{a}.lon"), F.col(f"{a}.lat"), F.col(f"{b}.lon"), F.col(f"{b}.lat"))


def plates_near(spark: SparkSession, folder: str) -> DataFrame:
    """How many plates lie strictly within 40 m of each amenity that has any."""
    plates = _labels(spark, folder, "kind").filter("kind = 'plate'")
    a, b = _amenities(spark, folder), plates
    met = within_join(a, "amenity_id", b, "label_id", PLATE_REACH_M)
    told = met.join(a.select(F.col("amenity_id").alias("query_id"), F.struct("lon", "lat").alias("a")), "query_id").join(b.select(F.col("label_id").alias("target_id"), F.struct("lon", "lat").alias("b")), "target_id")
    return told.filter(_metres("a", "b") < PLATE_REACH_M).groupBy(F.col("query_id").alias("amenity_id")).agg(F.count(F.lit(1)).alias("plates"))


def entrances(spark: SparkSession, folder: str) -> DataFrame:
    """The lamp nearest to any corner of each outline: the closest pair of the group."""
    corners = _outlines(spark, folder).select("boundary_id", F.explode(F.flatten("rings")).alias("p")).select("boundary_id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")).distinct()
    corners = corners.withColumn("corner", F.xxhash64("boundary_id", "lon", "lat"))
    found = nearest_join(corners, "corner", table(spark, folder, "lamps", "lamp_id", "lon", "lat"), "lamp_id")
    best = found.join(corners.select("boundary_id", F.col("corner").alias("query_id")), "query_id").groupBy("boundary_id").agg(F.min(F.struct(F.round("metres", 4).alias("metres"), "target_id")).alias("b"))
    return best.select("boundary_id", F.col("b.target_id").alias("lamp_id"), F.col("b.metres").alias("metres"))


def ring_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines whose very rings no outline of a lower id has."""
    rows = _outlines(spark, folder).select("boundary_id", F.sha2(F.to_json("rings"), 256).alias("shape"))
    return rows.groupBy("shape").agg(F.min("boundary_id").alias("boundary_id"), F.count(F.lit(1)).alias("drawn")).select("boundary_id", "drawn")


def boxed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that lie in some outline and are no area, by kind: a semi join; and those in none: an anti join."""
    rows = _labels(spark, folder, "kind").filter("kind is null or kind <> 'area'")
    inside = areas.containing(rows, "label_id", _outlines(spark, folder), "boundary_id").select(F.col("point").alias("label_id")).distinct()
    counts = lambda how, name: rows.join(inside, "label_id", how).groupBy("kind").agg(F.count(F.lit(1)).alias(name))
    a, b = counts("left_semi", "inside"), counts("left_anti", "outside")
    both = a.join(b.withColumnRenamed("kind", "k"), F.col("kind").eqNullSafe(F.col("k")), "full")
    return both.select(F.coalesce("kind", "k").alias("kind"), F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("outside", F.lit(0)).alias("outside"))


def outline_contents(spark: SparkSession, folder: str) -> DataFrame:
    """What each outline holds: distinct label texts in order, and amenities by kind, with their number from two on."""
    labels = _labels(spark, folder, "text").filter("text is not null")
    inside = areas.containing(labels, "label_id", _outlines(spark, folder), "boundary_id").join(labels.select(F.col("label_id").alias("point"), "text"), "point")
    contents = inside.groupBy("area").agg(F.sort_array(F.collect_set("text")).alias("t"))
    amenities = _amenities(spark, folder, "kind").filter("kind is not null")
    counted = areas.containing(amenities, "amenity_id", _outlines(spark, folder), "boundary_id").join(amenities.select(F.col("amenity_id").alias("point"), "kind"), "point").groupBy("area", "kind").agg(F.count(F.lit(1)).alias("n"))
    told = counted.withColumn("t", F.when(F.col("n") > 1, F.concat("kind", F.lit(" ×"), "n")).otherwise(F.col("kind")))
    facilities = told.groupBy("area").agg(F.sort_array(F.collect_list(F.struct("kind", "t"))).alias("f"), F.sum("n").alias("amenities"))
    rows = _outlines(spark, folder).select(F.col("boundary_id").alias("area")).join(contents, "area", "left").join(facilities, "area", "left")
    return rows.select(F.col("area").alias("boundary_id"), F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("texts"), F.md5(F.array_join("t", "|")).alias("texts_md5"), F.coalesce(F.array_join("f.t", " · "), F.lit("")).alias("facilities"), F.coalesce("amenities", F.lit(0)).alias("amenities"))


#: Names that mean an entry of the directory under another name.
ALIASES = {"ops yard": "operations", "main gym": "gymnasium"}


def alias_join(spark: SparkSession, folder: str) -> DataFrame:
    """Label texts joined to the directory by name, after a table of aliases; unmatched ones are kept."""
    names = table(spark, folder, "directory", "building_id", "name")
    alias = spark.createDataFrame(list(ALIASES.items()), "k string, means string")
    rows = table(spark, folder, "labels", "text").filter("text is not null").withColumn("k", F.trim(F.lower("text")))
    wanted = rows.join(F.broadcast(alias), "k", "left").withColumn("want", F.coalesce("means", "k"))
    found = wanted.join(F.broadcast(names.select(F.lower("name").alias("want"), "building_id")), "want", "left")
    return found.groupBy("building_id").agg(F.count(F.lit(1)).alias("labels"))


def roof_of_building(spark: SparkSession, folder: str) -> DataFrame:
    """Roofs of each directory entry by equal name: number, highest peak and largest area."""
    names = table(spark, folder, "directory", "building_id", "name")
    roofs = table(spark, folder, "roofs", "name", "peak_m", "area_m2")
    found = roofs.join(F.broadcast(names), "name")
    return found.groupBy("building_id").agg(F.count(F.lit(1)).alias("roofs"), F.max("peak_m").alias("peak_m"), F.max("area_m2").alias("area_m2"))


def node_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions behind the lists of ids that label texts carry: ids exploded in order, unusable ones dropped."""
    rows = _labels(spark, folder, "text")
    lists = rows.filter("text is not null").groupBy("text").agg(F.sort_array(F.collect_list("label_id")).alias("ids"))
    nodes = rows.select("label_id", "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90")
    found = lists.select("text", F.posexplode("ids").alias("at", "label_id")).join(nodes, "label_id")
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("points"), F.min_by("label_id", "at").alias("first"))


def meetings_by_building(spark: SparkSession, folder: str) -> DataFrame:
    """Meetings and distinct rooms of each building as written, with the campus of its first meeting."""
    rows = table(spark, folder, "meetings", "meeting_id", "building", "room", "campus").filter("building is not null")
    return rows.groupBy("building").agg(F.count(F.lit(1)).alias("sections"), F.count_distinct("room").alias("rooms"), F.min_by("campus", "meeting_id").alias("campus"))


def near_plain_list(spark: SparkSession, folder: str) -> DataFrame:
    """For each kind, its amenities from the nearest to the map's middle on: feet and rank."""
    rows = _amenities(spark, folder, "kind").filter("kind is not null and lon between -180 and 180 and lat between -90 and 90")
    middle = rows.agg(F.avg("lon").alias("mx"), F.avg("lat").alias("my"))
    feet = F.round(geo.great_circle_m(F.col("lon"), F.col("lat"), F.round("mx", 3), F.round("my", 3)) * geo.FEET_PER_METRE, 2)
    far = rows.join(F.broadcast(middle)).select("kind", "amenity_id", feet.alias("feet"))
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("feet", "amenity_id"))).filter("rank <= 20")


def directory_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The directory by area, largest first, then by name as a reader sorts names. The list is of fixed size, so one task orders it."""
    rows = table(spark, folder, "directory", "building_id", "name", "area_m2")
    order = Window.orderBy(F.col("area_m2").desc_nulls_last(), F.collate("name", "UNICODE"), "building_id")
    return rows.select("building_id", F.row_number().over(order).alias("place"))


QUERIES = {f.__name__: f for f in (area_or_near, gate_candidates, highlight_rollup, category_rows, outline_names, plates_near, entrances, ring_anti, boxed_labels, outline_contents, alias_join, roof_of_building, node_positions, meetings_by_building, near_plain_list, directory_in_order)}

_GC = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2))))"
_KX, _KY = "(111320.0 * cos(radians(38.6547)))", "111320.0"
_AX, _AY, _BX, _BY = f"((x1 - lon) * {_KX})", f"((y1 - lat) * {_KY})", f"((x2 - lon) * {_KX})", f"((y2 - lat) * {_KY})"
_T = f"greatest(0.0, least(1.0, coalesce(-({_AX} * ({_BX} - {_AX}) + {_AY} * ({_BY} - {_AY})) / nullif(pow({_BX} - {_AX}, 2) + pow({_BY} - {_AY}, 2), 0), 0.0)))"
_AWAY = f"sqrt(pow({_AX} + {_T} * ({_BX} - {_AX}), 2) + pow({_AY} + {_T} * ({_BY} - {_AY}), 2))"


def _near(points: str, key: str, reach: float) -> str:
    return f"""n AS (SELECT {key} AS point, boundary_id AS area, min({_AWAY}) AS metres FROM (SELECT {key}, lon, lat FROM {points} WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) p
  JOIN edge ON lon BETWEEN least(x1, x2) - 0.001 AND greatest(x1, x2) + 0.001 AND lat BETWEEN least(y1, y2) - 0.001 AND greatest(y1, y2) + 0.001 GROUP BY 1, 2 HAVING min({_AWAY}) <= {reach})"""


def _inside(points: str, key: str) -> str:
    return INSIDE_SQL.replace("FROM amenities", f"FROM {points}").replace("amenity_id", key)


_IN_AMENITIES, _IN_LABELS = _inside("amenities", "amenity_id"), _inside("(SELECT * FROM labels WHERE text IS NOT NULL)", "label_id")
ORACLES = {
    "area_or_near": f"""{_IN_AMENITIES}, {_near("amenities", "amenity_id", PLACE_REACH_M)}, f AS (SELECT amenity_id, min(boundary_id) AS boundary_id, 0.0 AS metres FROM inside GROUP BY 1),
b AS (SELECT point, area, metres, row_number() OVER (PARTITION BY point ORDER BY metres, area DESC) AS rn FROM n)
SELECT amenity_id, boundary_id, CAST(metres AS DOUBLE) AS metres FROM f UNION ALL SELECT point, area, round(metres, 3) FROM b WHERE rn = 1 AND point NOT IN (SELECT amenity_id FROM f)""",
    "gate_candidates": f"""{_IN_AMENITIES}, {_near("lamps", "lamp_id", GATE_M)} SELECT point AS lamp_id, area AS boundary_id, round(metres, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY metres, area) AS rn FROM n) WHERE rn = 1""",
    "highlight_rollup": f"""{_IN_AMENITIES}, f AS (SELECT amenity_id, min(boundary_id) AS area FROM inside GROUP BY 1), r AS (SELECT kind, area FROM amenities LEFT JOIN f USING (amenity_id) WHERE kind IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL)
SELECT kind, coalesce(array_to_string(list_sort(list(DISTINCT area) FILTER (WHERE area IS NOT NULL)), ','), '') AS areas, count(DISTINCT area) AS buildings, count(*) FILTER (WHERE area IS NULL) AS outside FROM r GROUP BY kind""",
    "category_rows": f"""WITH m AS (SELECT unnest([{", ".join(f"{{'c': '{c}', 'k': '{k}'}}" for c, ks in CATEGORIES.items() for k in ks)}]) AS m), n AS (SELECT unnest([{", ".join(f"'{c}'" for c in CATEGORIES)}]) AS c)
SELECT category, icon, count(*) AS things FROM (SELECT m.c AS category, kind AS icon FROM amenities JOIN m ON m.k = kind WHERE lon IS NOT NULL AND lat IS NOT NULL
  UNION ALL SELECT c, c FROM labels JOIN n ON contains(lower(text), c) WHERE lon IS NOT NULL AND lat IS NOT NULL) GROUP BY 1, 2""",
    "outline_names": f"""{_IN_LABELS}, {AREA_SQL},
sm AS (SELECT label_id, arg_min(i.boundary_id, {{'s': size, 'b': i.boundary_id}}) AS area FROM inside i JOIN sized s ON s.boundary_id = i.boundary_id GROUP BY label_id),
fi AS (SELECT area, arg_min(text, sm.label_id) AS own FROM sm JOIN labels l ON l.label_id = sm.label_id GROUP BY area),
ce AS (SELECT boundary_id AS point, x0 + sx / (3 * k) AS lon, y0 + sy / (3 * k) AS lat FROM (SELECT boundary_id, any_value(x0) AS x0, any_value(y0) AS y0, sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) AS k,
  sum((x1 + x2 - 2 * x0) * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) AS sx, sum((y1 + y2 - 2 * y0) * ((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) AS sy FROM edge WHERE r = 1 GROUP BY boundary_id)),
cp AS (SELECT point, boundary_id, r, count(*) FILTER (WHERE (lat < y1) <> (lat < y2) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) % 2 AS odd FROM ce JOIN edge ON point <> boundary_id GROUP BY ALL),
ci AS (SELECT point, boundary_id FROM cp GROUP BY ALL HAVING sum(CASE WHEN r = 1 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN r > 1 THEN odd ELSE 0 END) = 0),
se AS (SELECT point, arg_min(own, {{'s': size, 'b': ci.boundary_id}}) AS around FROM ci JOIN sized s ON s.boundary_id = ci.boundary_id JOIN fi ON fi.area = ci.boundary_id GROUP BY point)
SELECT b.boundary_id, coalesce(own, around) AS name, CASE WHEN own IS NOT NULL THEN 1 WHEN around IS NOT NULL THEN 2 END AS pass FROM campus_boundary b LEFT JOIN fi ON fi.area = b.boundary_id LEFT JOIN se ON se.point = b.boundary_id""",
    "plates_near": f"""WITH a AS (SELECT amenity_id, lon, lat FROM amenities WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), b AS (SELECT lon, lat FROM labels WHERE kind = 'plate' AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90)
SELECT amenity_id, count(*) AS plates FROM a JOIN b ON b.lat BETWEEN a.lat - 0.001 AND a.lat + 0.001 AND b.lon BETWEEN a.lon - 0.002 AND a.lon + 0.002 WHERE {_GC.format(a="a.lon", b="a.lat", c="b.lon", d="b.lat")} < 40 GROUP BY 1""",
    "entrances": f"""WITH c AS (SELECT DISTINCT boundary_id, p.lon AS x, p.lat AS y FROM (SELECT boundary_id, unnest(flatten(rings)) AS p FROM campus_boundary)), l AS (SELECT lamp_id, lon, lat FROM lamps WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
m AS (SELECT boundary_id, lamp_id, round(min({_GC.format(a="x", b="y", c="lon", d="lat")}), 4) AS metres FROM c, l GROUP BY 1, 2)
SELECT boundary_id, arg_min(lamp_id, {{'m': metres, 'l': lamp_id}}) AS lamp_id, min(metres) AS metres FROM m GROUP BY 1""",
    "ring_anti": "SELECT min(boundary_id) AS boundary_id, count(*) AS drawn FROM campus_boundary GROUP BY CAST(rings AS VARCHAR)",
    "boxed_labels": f"""{_inside("labels", "label_id")}, i AS (SELECT DISTINCT label_id FROM inside), r AS (SELECT kind, label_id IN (SELECT label_id FROM i) AS held FROM labels WHERE kind IS NULL OR kind <> 'area')
SELECT kind, count(*) FILTER (WHERE held) AS inside, count(*) FILTER (WHERE NOT held) AS outside FROM r GROUP BY kind""",
    "outline_contents": f"""{_IN_LABELS}, t AS (SELECT i.boundary_id, list_sort(list(DISTINCT text)) AS t FROM inside i JOIN labels l ON l.label_id = i.label_id GROUP BY 1),
u2 AS (SELECT amenity_id, kind, lon, lat FROM amenities WHERE kind IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
p2 AS (SELECT amenity_id, kind, boundary_id, r, count(*) FILTER (WHERE (lat < y1) <> (lat < y2) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) % 2 AS odd FROM u2 JOIN edge ON lon BETWEEN x1 - 0.05 AND x1 + 0.05 AND lat BETWEEN y1 - 0.05 AND y1 + 0.05 GROUP BY ALL),
i2 AS (SELECT amenity_id, kind, boundary_id FROM p2 GROUP BY ALL HAVING sum(CASE WHEN r = 1 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN r > 1 THEN odd ELSE 0 END) = 0),
k AS (SELECT boundary_id, kind, count(*) AS n FROM i2 GROUP BY 1, 2), f AS (SELECT boundary_id, string_agg(CASE WHEN n > 1 THEN kind || ' ×' || n ELSE kind END, ' · ' ORDER BY kind) AS f, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1)
SELECT b.boundary_id, CAST(coalesce(len(t), 0) AS BIGINT) AS texts, md5(array_to_string(t, '|')) AS texts_md5, coalesce(f, '') AS facilities, coalesce(n, 0) AS amenities FROM campus_boundary b LEFT JOIN t ON t.boundary_id = b.boundary_id LEFT JOIN f ON f.boundary_id = b.boundary_id""",
    "alias_join": f"""WITH w AS (SELECT CASE trim(lower(text), ' ') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE trim(lower(text), ' ') END AS want FROM labels WHERE text IS NOT NULL)
SELECT building_id, count(*) AS labels FROM w LEFT JOIN directory d ON lower(d.name) = want GROUP BY 1""",
    "roof_of_building": "SELECT building_id, count(*) AS roofs, max(peak_m) AS peak_m, max(r.area_m2) AS area_m2 FROM roofs r JOIN directory d ON d.name = r.name GROUP BY 1",
    "node_positions": "SELECT text, count(*) AS points, min(label_id) AS first FROM labels WHERE text IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY 1",
    "meetings_by_building": "SELECT building, count(*) AS sections, count(DISTINCT room) AS rooms, arg_min_null(campus, meeting_id) AS campus FROM meetings WHERE building IS NOT NULL GROUP BY 1",
    "near_plain_list": f"""WITH r AS (SELECT kind, amenity_id, lon, lat FROM amenities WHERE kind IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90), m AS (SELECT round(avg(lon), 3) AS mx, round(avg(lat), 3) AS my FROM r),
f AS (SELECT kind, amenity_id, round({_GC.format(a="lon", b="lat", c="mx", d="my")} * 3.28084, 2) AS feet FROM r, m), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY feet, amenity_id) AS INTEGER) AS rank FROM f) SELECT kind, amenity_id, feet, rank FROM o WHERE rank <= 20""",
    "directory_in_order": "SELECT building_id, CAST(row_number() OVER (ORDER BY area_m2 DESC NULLS LAST, name COLLATE NOCASE, building_id) AS INTEGER) AS place FROM directory",
}
