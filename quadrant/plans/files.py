"""Queries of the file sources: documents are made from the test tables, then read by the source's own parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions import geo, shapes
from quadrant.sources import drawings, geojson, pages
from quadrant.sources.tables import table


def drawn_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Campus outlines drawn as SVG paths within a moved and doubled group, beside a box and a circle: elements, points and areas as read back."""
    rows = table(spark, folder, "campus_boundary", "boundary_id", "rings").filter("size(rings) > 0")
    flat = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(" ", F.floor((p["lon"] - F.floor(p["lon"])) * 1000000) / 1000, F.floor((p["lat"] - F.floor(p["lat"])) * 1000000) / 1000)), " L ")
    path = F.array_join(F.transform("rings", lambda r: F.concat(F.lit("M "), flat(r), F.lit(" Z"))), " ")
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><defs><rect width="9" height="9"/></defs><g id="land" transform="translate(5 7) scale(2)"><path fill="#fff" d="'), path, F.lit('"/><rect x="1" y="2" width="3" height="4" stroke="red"/></g><circle cx="1" cy="1" r="2"/></svg>'))
    found = drawings.parse_drawings(rows.select(F.col("boundary_id").cast("string").alias("file"), svg.alias("value")))
    ring = F.transform("points", lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    measured = found.select(F.col("file").cast("long").alias("boundary_id"), "element", "layer", F.size("points").alias("n"), F.abs(geo.ring_area(ring)).alias("a"))
    return measured.groupBy("boundary_id", "element", "layer").agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").cast("long").alias("points"), F.round(F.sum("a"), 6).alias("area"))


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Amenities written as GeoJSON features and read again; what is absent stays absent."""
    rows = table(spark, folder, "amenities", "amenity_id", "kind", "label", "lon", "lat")
    features = geojson.point_features(rows, ["amenity_id", "kind", "label"])
    shape = "struct<type: string, properties: struct<amenity_id: bigint, kind: string, label: string>, geometry: struct<type: string, coordinates: array<double>>>"
    read = features.select(F.from_json("value", shape).alias("f"))
    return read.select("f.properties.amenity_id", "f.properties.kind", "f.properties.label", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def meetings_scrape(spark: SparkSession, folder: str) -> DataFrame:
    """Section cards written as pages of label-value items, with a comment in between, and read again: items by label, and rooms that hold digits."""
    rows = table(spark, folder, "meetings", "meeting_id", "course", "section", "room").filter("course is not null and section is not null and room is not null and course not rlike '[<:]' and section not rlike '[<:]' and room not rlike '[<:&]'")
    page = F.concat(F.lit('<html><div class="card"><ul><li><span>Course</span>: '), "course", F.lit("</li><!-- <li>Old: x</li> --><li>Class: "), "section", F.lit("</li><li>Room: "), "room", F.lit("</li></ul></div></html>"))
    found = pages.items(rows.select("meeting_id", page.alias("html")), "meeting_id", "html")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("value").alias("values"), F.count(F.when(F.col("value").rlike("[0-9]"), 1)).alias("numbered"))


def coordinate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Positions given as text, good and bad, parsed or refused."""
    rows = table(spark, folder, "lamps", "lamp_id", "lon", "lat")
    text = F.when(F.pmod("lamp_id", F.lit(7)) == 0, F.concat("lon", F.lit(","))).when(F.pmod("lamp_id", F.lit(7)) == 1, F.concat_ws(",", "lat", "lon", "lat")).when(F.pmod("lamp_id", F.lit(7)) == 2, F.lit("north,east")).otherwise(F.concat("lon", F.lit(","), "lat"))
    parsed = rows.select("lamp_id", text.alias("t")).select(F.pmod("lamp_id", F.lit(7)).alias("form"), geo.parse_coordinate(F.col("t")).alias("p"))
    return parsed.groupBy("form").agg(F.count("p").alias("good"), F.count(F.lit(1)).alias("all"), F.round(F.sum("p.lon"), 3).alias("lon"), F.round(F.sum("p.lat"), 3).alias("lat"))


#: Affine form of a drawing: lon and lat of its origin and of one unit along each axis.
DRAWING = (-121.351, 1.9e-05, 0.0, 38.653, 0.0, -1.5e-05)


def projected_roofs(spark: SparkSession, folder: str) -> DataFrame:
    """Roof centres taken back to drawing units and forth again: the way there and back is within a rounded unit."""
    rows = table(spark, folder, "roofs", "roof_id", "centre").filter("size(centre) >= 2 and centre[0] is not null and centre[1] is not null").select("roof_id", F.col("centre")[0].alias("lon"), F.col("centre")[1].alias("lat"))
    x, y = geo.affine_inverse(F.col("lon"), F.col("lat"), *DRAWING)
    back = rows.withColumn("x", x).withColumn("y", y)
    lon, lat = geo.affine(F.col("x"), F.col("y"), *DRAWING)
    return back.select("roof_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), lon.alias("lon"), lat.alias("lat"))


def flattened_lamps(spark: SparkSession, folder: str) -> DataFrame:
    """Lamps in flat metres and back."""
    rows = table(spark, folder, "lamps", "lamp_id", "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90")
    model = geo.FLAT_MODELS["D2"]
    x, y = model.flat(F.col("lon"), F.col("lat"))
    lon, lat = model.unflat(x, y)
    return rows.select("lamp_id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), lon.alias("lon"), lat.alias("lat"))


def expanded_box(spark: SparkSession, folder: str) -> DataFrame:
    """The box of each outline with 250 m added on every side, and the lamps in it."""
    box = shapes.extent(F.col("rings"))
    grown = geo.grown_box(box, 250.0)
    rows = table(spark, folder, "campus_boundary", "boundary_id", "rings").filter("size(rings) > 0").select("boundary_id", grown.alias("b"))
    return rows.select("boundary_id", *[F.round(f"b.{k}", 7).alias(k) for k in ("west", "south", "east", "north")])


QUERIES = {f.__name__: f for f in (drawn_outlines, feature_rows, meetings_scrape, coordinate_texts, projected_roofs, flattened_lamps, expanded_box)}

ORACLES = {
    "drawn_outlines": """WITH o AS (SELECT boundary_id, unnest(range(1, len(rings) + 1)) AS r, rings FROM campus_boundary WHERE len(rings) > 0), p AS (SELECT boundary_id, r, rings[r] AS v, unnest(range(1, len(rings[r]) + 1)) AS i FROM o),
f AS (SELECT boundary_id, r, i, 5 + 2 * floor((v[i].lon - floor(v[i].lon)) * 1000000) / 1000 AS x, 7 + 2 * floor((v[i].lat - floor(v[i].lat)) * 1000000) / 1000 AS y FROM p),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM f WINDOW w AS (PARTITION BY boundary_id, r ORDER BY i)),
a AS (SELECT boundary_id, r, count(*) AS points, abs(sum((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0))) / 2 AS area FROM n GROUP BY 1, 2)
SELECT boundary_id, 'path' AS element, 'land' AS layer, count(*) AS shapes, CAST(sum(points) AS BIGINT) AS points, round(sum(area), 6) AS area FROM a GROUP BY 1
UNION ALL SELECT boundary_id, 'rect', 'land', 1, 4, 48.0 FROM campus_boundary WHERE len(rings) > 0 UNION ALL SELECT boundary_id, 'circle', NULL, 1, 24, round(48 * sin(pi() / 12), 6) FROM campus_boundary WHERE len(rings) > 0""",
    "feature_rows": "SELECT amenity_id, kind, label, CASE WHEN lat IS NOT NULL THEN lon END AS lon, CASE WHEN lon IS NOT NULL THEN lat END AS lat FROM amenities",
    "meetings_scrape": """WITH m AS (SELECT * FROM meetings WHERE course IS NOT NULL AND section IS NOT NULL AND room IS NOT NULL AND NOT regexp_matches(course, '[<:]') AND NOT regexp_matches(section, '[<:]') AND NOT regexp_matches(room, '[<:&]')),
i AS (SELECT 'Course' AS label, trim(course, ' ') AS value FROM m UNION ALL SELECT 'Class', trim(section, ' ') FROM m UNION ALL SELECT 'Room', trim(room, ' ') FROM m)
SELECT label, count(*) AS items, count(DISTINCT value) AS values, count(*) FILTER (WHERE regexp_matches(value, '[0-9]')) AS numbered FROM i GROUP BY 1""",
    "coordinate_texts": """WITH p AS (SELECT lamp_id % 7 AS form, CASE WHEN lamp_id % 7 = 0 THEN lon WHEN lamp_id % 7 IN (1, 2) THEN NULL ELSE lon END AS x, CASE WHEN lamp_id % 7 = 0 THEN CASE WHEN lon IS NOT NULL THEN 0.0 END WHEN lamp_id % 7 IN (1, 2) THEN NULL ELSE lat END AS y FROM lamps),
g AS (SELECT form, x IS NOT NULL AND y IS NOT NULL AND abs(x) <= 180 AND abs(y) <= 90 AS good, x, y FROM p)
SELECT form, count(*) FILTER (WHERE good) AS good, count(*) AS all, round(sum(x) FILTER (WHERE good), 3) AS lon, round(sum(y) FILTER (WHERE good), 3) AS lat FROM g GROUP BY 1""",
    "projected_roofs": """WITH r AS (SELECT roof_id, centre[1] AS lon, centre[2] AS lat FROM roofs WHERE len(centre) >= 2 AND centre[1] IS NOT NULL AND centre[2] IS NOT NULL)
SELECT roof_id, round((lon + 121.351) / 1.9e-05, 2) AS x, round((38.653 - lat) / 1.5e-05, 2) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM r""",
    "flattened_lamps": """SELECT lamp_id, round(lon * 6371008.8 * pi() / 180 * cos(radians(38.6493)), 2) AS x, round(lat * 6371008.8 * pi() / 180, 2) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM lamps WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90""",
    "expanded_box": """WITH p AS (SELECT boundary_id, p.lon AS lon, p.lat AS lat FROM (SELECT boundary_id, unnest(flatten(rings)) AS p FROM campus_boundary WHERE len(rings) > 0))
SELECT boundary_id, round(min(lon) - 250 / 86900.0, 7) AS west, round(min(lat) - 250 / 111132.0, 7) AS south, round(max(lon) + 250 / 86900.0, 7) AS east, round(max(lat) + 250 / 111132.0, 7) AS north FROM p GROUP BY 1""",
}
