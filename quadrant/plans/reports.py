"""Aggregation, lookup and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions.text import first_match, squeezed_key
from quadrant.functions.units import half_up
from quadrant.operators.farthest import spread
from quadrant.sources.tables import table

#: Kinds of parts, in the order they are listed; every one is listed, empty or not.
PART_CLASSES = ["economy", "promo", "medium", "standard", "large", "small", "other"]
PART_RULES = [(r"^economy\b", "economy"), (r"\bpromo", "promo"), (r"^medium\b", "medium"), (r"^standard\b", "standard"), (r"^large\b", "large"), (r"^small\b", "small")]


def group_index(spark: SparkSession, folder: str) -> DataFrame:
    """Amenities with a position by label: how many, the kind of the first, and all points in the order of their ids."""
    rows = table(spark, folder, "amenities", "amenity_id", "kind", "label", "lon", "lat").filter("label is not null and lon is not null and lat is not null")
    point = F.struct("amenity_id", F.round(F.col("lon") * 1e7).cast("long").alias("x"), F.round(F.col("lat") * 1e7).cast("long").alias("y"))
    grouped = rows.groupBy("label").agg(F.count(F.lit(1)).alias("points"), F.min(F.struct("amenity_id", "kind")).alias("first"), F.array_sort(F.collect_list(point)).alias("at"))
    text = F.array_join(F.transform("at", lambda p: F.concat_ws(" ", p["amenity_id"], p["x"], p["y"])), ",")
    return grouped.select("label", "points", F.col("first.kind").alias("first_kind"), F.md5(text).alias("points_md5"))


def kind_source_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Amenities per kind, drawn and listed side by side."""
    rows = table(spark, folder, "amenities", "kind", "source")
    return rows.groupBy("kind").pivot("source", ["artwork", "locations"]).agg(F.count(F.lit(1))).select("kind", F.coalesce("artwork", F.lit(0)).alias("artwork"), F.coalesce("locations", F.lit(0)).alias("locations"))


def facility_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Footprints, area and named parts of the directory by kind of name, largest first within the kind."""
    rows = table(spark, folder, "directory", "name", "footprints", "area_m2", "parts").withColumn("kind", F.element_at(F.split("name", " "), -1))
    return rows.groupBy("kind").agg(F.sum("footprints").cast("long").alias("footprints"), F.sum("area_m2").alias("area_m2"), F.count(F.lit(1)).alias("entries"), F.sum(F.coalesce(F.greatest(F.size("parts"), F.lit(0)), F.lit(0))).cast("long").alias("parts"), F.max_by("name", F.struct("area_m2", "name")).alias("largest"))


def unique_label_only(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose text no other label has."""
    counts = table(spark, folder, "labels", "label_id", "text").filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("label_id").alias("label_id"))
    return counts.filter("n = 1").select("label_id", "text")


def class_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by class, the first rule that matches their type; empty classes are listed too."""
    classes = spark.createDataFrame([(i, c) for i, c in enumerate(PART_CLASSES)], "ordinal int, class string")
    counted = table(spark, folder, "part", "p_type").select(first_match(F.col("p_type"), PART_RULES, "other").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("parts"))
    return classes.join(counted, "class", "left").select("ordinal", "class", F.coalesce("parts", F.lit(0)).alias("parts"))


def grid_minmax(spark: SparkSession, folder: str) -> DataFrame:
    """Highest and lowest peak of the roofs in each cell of a grid of a hundredth of a degree."""
    rows = table(spark, folder, "roofs", "centre", "peak_m").filter("size(centre) >= 2 and peak_m is not null")
    cell = rows.groupBy(F.floor(F.element_at("centre", 1) * 100).alias("ix"), F.floor(F.element_at("centre", 2) * 100).alias("iy"))
    return cell.agg(F.max("peak_m").alias("high"), F.min("peak_m").alias("low"), F.count(F.lit(1)).alias("roofs"))


def roof_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of heights by tenth of the roofs' area on a log scale."""
    rows = table(spark, folder, "roofs", "area_m2", "height_m").filter("area_m2 > 0 and height_m is not null").withColumn("size", F.floor(F.log10(F.col("area_m2").cast("double")) * 2))
    cut = [F.round(F.percentile("height_m", F.lit(p)), 6).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))]
    return rows.groupBy("size").agg(*cut, F.count(F.lit(1)).alias("roofs"))


def _rooms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "meetings", "building", "room", "campus").filter("building is not null and room is not null and trim(building) <> '' and trim(room) <> ''")


def room_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Building-and-room keys of the home campus with the rows behind each and in how many buildings the room number exists."""
    known = table(spark, folder, "directory", "name").select("name", squeezed_key(F.col("name")).alias("key"))
    rows = _rooms(spark, folder).filter("campus = 'Hillside Campus'").select(squeezed_key(F.col("building")).alias("key"), F.upper(F.trim("room")).alias("room"))
    pairs = rows.join(F.broadcast(known), "key").groupBy("name", "room").agg(F.count(F.lit(1)).alias("meetings"))
    return pairs.withColumn("one_of", F.count(F.lit(1)).over(Window.partitionBy("room")))


def room_ambiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms by the number of buildings that have them, and the meetings in such rooms."""
    pairs = room_lookup(spark, folder)
    return pairs.groupBy(F.col("one_of").alias("buildings")).agg(F.count_distinct("room").alias("rooms"), F.sum("meetings").alias("meetings"))


def course_first_title(spark: SparkSession, folder: str) -> DataFrame:
    """Each course's title as first read, how many titles it has, and its sections."""
    rows = table(spark, folder, "meetings", "meeting_id", "course", "title", "section").filter("course is not null")
    return rows.groupBy("course").agg(F.min(F.struct("meeting_id", "title")).alias("f"), F.count_distinct("title").alias("titles"), F.count_distinct("section").alias("sections")).select("course", F.col("f.title").alias("title"), "titles", "sections")


def first_name_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Union of building names by squeezed key, in order directory, then roofs: the first to name a key keeps it."""
    directory = table(spark, folder, "directory", "building_id", "name").select(F.lit(0).alias("rank"), F.col("building_id").alias("id"), "name")
    roofs = table(spark, folder, "roofs", "roof_id", "name").select(F.lit(1).alias("rank"), F.col("roof_id").alias("id"), "name")
    both = directory.unionByName(roofs).filter("name is not null").withColumn("key", squeezed_key(F.col("name"))).filter("key <> ''")
    return both.groupBy("key").agg(F.min(F.struct("rank", "id", "name")).alias("f"), F.count(F.lit(1)).alias("uses")).select("key", F.col("f.rank").alias("source"), F.col("f.name").alias("name"), "uses")


SPREAD_M = 250.0


def _spreads(spark: SparkSession, folder: str) -> DataFrame:
    """Label texts with their usable points, their mean and the largest distance of two of them."""
    rows = table(spark, folder, "labels", "label_id", "text", "lon", "lat").filter("text is not null")
    ok = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    groups = rows.groupBy("text").agg(F.count(F.when(ok, 1)).alias("points"), F.avg(F.when(ok, F.col("lon"))).alias("x"), F.avg(F.when(ok, F.col("lat"))).alias("y"))
    kind = F.when(F.col("points") == 0, "unpositioned").when(F.col("spread_m") > SPREAD_M, "amenity_class").otherwise("place")
    return groups.join(spread(rows, "text"), "text", "left").withColumn("kind", kind)


def label_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Per label text: how far its points spread, and whether it is one place, a class of several, or nowhere."""
    return _spreads(spark, folder).select("text", "points", "kind", half_up(F.round("spread_m", 6)).cast("long").alias("span_m"))


def place_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Places made of labels of one text: one row at the mean of its points, a row for each point of a class, one row without a point if there is none."""
    spreads = _spreads(spark, folder)
    rows = table(spark, folder, "labels", "label_id", "text", "lon", "lat").filter("lon between -180 and 180 and lat between -90 and 90")
    members = rows.join(spreads.filter("kind = 'amenity_class'").select("text", "kind"), "text").select("text", "kind", "label_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.lit(None).cast("long").alias("spread_m"))
    single = spreads.filter("kind <> 'amenity_class'").select("text", "kind", F.lit(None).cast("long").alias("label_id"), F.round("x", 7).alias("lon"), F.round("y", 7).alias("lat"), F.when(F.col("kind") == "place", half_up(F.round("spread_m", 6)).cast("long")).alias("spread_m"))
    return members.unionByName(single)


def lang_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per language tag without region and case, with the sources they come from."""
    rows = table(spark, folder, "documents", "lang", "source", "n_chars").withColumn("tag", F.lower(F.substring_index("lang", "-", 1)))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Meetings by whole hours between reading and loading."""
    rows = table(spark, folder, "meetings", "seen_at", "loaded_at").filter("seen_at is not null and loaded_at is not null")
    hours = F.floor((F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))) / 3_600_000_000)
    return rows.groupBy(hours.alias("hours")).agg(F.count(F.lit(1)).alias("meetings"))


QUERIES = {f.__name__: f for f in (group_index, kind_source_pivot, facility_counts, unique_label_only, class_partition, grid_minmax, roof_percentiles, room_lookup, room_ambiguity, course_first_title, first_name_wins, label_spread, place_rows, lang_sources, late_rows)}

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_LOOKUP = f"""
WITH k AS (SELECT name, {_KEY.format("name")} AS key FROM directory),
m AS (SELECT {_KEY.format("building")} AS key, upper(trim(room, ' ')) AS room FROM meetings
  WHERE building IS NOT NULL AND room IS NOT NULL AND trim(building, ' ') <> '' AND trim(room, ' ') <> '' AND campus = 'Hillside Campus'),
p AS (SELECT name, room, count(*) AS meetings FROM m JOIN k USING (key) GROUP BY name, room),
o AS (SELECT *, count(*) OVER (PARTITION BY room) AS one_of FROM p)"""

_SPREADS = """WITH u AS (SELECT * FROM labels WHERE text IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
d AS (SELECT DISTINCT text, lon, lat FROM u),
f AS (SELECT a.text, max(sqrt(pow((a.lon - b.lon) * 111320 * cos(radians(a.lat)), 2) + pow((a.lat - b.lat) * 111320, 2))) AS spread_m FROM d a JOIN d b ON a.text = b.text GROUP BY a.text),
g AS (SELECT t.text, count(u.label_id) AS points, avg(u.lon) AS x, avg(u.lat) AS y FROM (SELECT DISTINCT text FROM labels WHERE text IS NOT NULL) t LEFT JOIN u ON u.text = t.text GROUP BY t.text),
k AS (SELECT g.*, f.spread_m, CASE WHEN points = 0 THEN 'unpositioned' WHEN spread_m > 250 THEN 'amenity_class' ELSE 'place' END AS kind FROM g LEFT JOIN f ON f.text = g.text)"""

ORACLES = {
    "group_index": """SELECT label, count(*) AS points, arg_min_null(kind, amenity_id) AS first_kind,
md5(string_agg(amenity_id || ' ' || CAST(round(lon * 1e7) AS BIGINT) || ' ' || CAST(round(lat * 1e7) AS BIGINT), ',' ORDER BY amenity_id)) AS points_md5
FROM amenities WHERE label IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY label""",
    "kind_source_pivot": "SELECT kind, count(*) FILTER (WHERE source = 'artwork') AS artwork, count(*) FILTER (WHERE source = 'locations') AS locations FROM amenities GROUP BY kind",
    "facility_counts": """SELECT split_part(name, ' ', -1) AS kind, CAST(sum(footprints) AS BIGINT) AS footprints, CAST(sum(area_m2) AS BIGINT) AS area_m2, count(*) AS entries,
CAST(sum(coalesce(len(parts), 0)) AS BIGINT) AS parts, arg_max(name, {'a': area_m2, 'n': name}) AS largest FROM directory GROUP BY 1""",
    "unique_label_only": "SELECT min(label_id) AS label_id, text FROM labels WHERE text IS NOT NULL GROUP BY text HAVING count(*) = 1",
    "class_partition": """WITH c AS (SELECT unnest(range(0, 7)) AS ordinal, unnest(['economy', 'promo', 'medium', 'standard', 'large', 'small', 'other']) AS class),
p AS (SELECT CASE WHEN regexp_matches(lower(p_type), '^economy\\b') THEN 'economy' WHEN regexp_matches(lower(p_type), '\\bpromo') THEN 'promo' WHEN regexp_matches(lower(p_type), '^medium\\b') THEN 'medium'
  WHEN regexp_matches(lower(p_type), '^standard\\b') THEN 'standard' WHEN regexp_matches(lower(p_type), '^large\\b') THEN 'large' WHEN regexp_matches(lower(p_type), '^small\\b') THEN 'small' ELSE 'other' END AS class FROM part)
SELECT CAST(ordinal AS INTEGER) AS ordinal, class, count(p.class) AS parts FROM c LEFT JOIN p USING (class) GROUP BY ordinal, class""",
    "grid_minmax": """SELECT CAST(floor(centre[1] * 100) AS BIGINT) AS ix, CAST(floor(centre[2] * 100) AS BIGINT) AS iy, max(peak_m) AS high, min(peak_m) AS low, count(*) AS roofs
FROM roofs WHERE len(centre) >= 2 AND peak_m IS NOT NULL GROUP BY 1, 2""",
    "roof_percentiles": """SELECT CAST(floor(log10(CAST(area_m2 AS DOUBLE)) * 2) AS BIGINT) AS size, round(quantile_cont(height_m, 0.1), 6) AS p10, round(quantile_cont(height_m, 0.5), 6) AS p50,
round(quantile_cont(height_m, 0.9), 6) AS p90, count(*) AS roofs FROM roofs WHERE area_m2 > 0 AND height_m IS NOT NULL GROUP BY 1""",
    "room_lookup": f"{_LOOKUP} SELECT name, room, meetings, one_of FROM o",
    "room_ambiguity": f"{_LOOKUP} SELECT one_of AS buildings, count(DISTINCT room) AS rooms, CAST(sum(meetings) AS BIGINT) AS meetings FROM o GROUP BY 1",
    "course_first_title": "SELECT course, arg_min_null(title, meeting_id) AS title, count(DISTINCT title) AS titles, count(DISTINCT section) AS sections FROM meetings WHERE course IS NOT NULL GROUP BY course",
    "first_name_wins": f"""WITH b AS (SELECT 0 AS source, building_id AS id, name FROM directory UNION ALL SELECT 1, roof_id, name FROM roofs), k AS (SELECT *, {_KEY.format("name")} AS key FROM b WHERE name IS NOT NULL)
SELECT key, source, name, uses FROM (SELECT *, count(*) OVER (PARTITION BY key) AS uses, row_number() OVER (PARTITION BY key ORDER BY source, id) AS rn FROM k WHERE key <> '') WHERE rn = 1""",
    "label_spread": f"{_SPREADS} SELECT text, points, kind, CAST(floor(round(spread_m, 6) + 0.5) AS BIGINT) AS span_m FROM k",
    "place_rows": f"""{_SPREADS}
SELECT l.text, k.kind, l.label_id, round(l.lon, 7) AS lon, round(l.lat, 7) AS lat, CAST(NULL AS BIGINT) AS spread_m FROM k JOIN u l ON l.text = k.text WHERE k.kind = 'amenity_class'
UNION ALL SELECT text, kind, NULL, round(x, 7), round(y, 7), CASE WHEN kind = 'place' THEN CAST(floor(round(spread_m, 6) + 0.5) AS BIGINT) END FROM k WHERE kind <> 'amenity_class'""",
    "lang_sources": """SELECT lower(split_part(lang, '-', 1)) AS tag, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1""",
    "late_rows": "SELECT CAST(floor((epoch_us(loaded_at) - epoch_us(seen_at)) / 3600000000.0) AS BIGINT) AS hours, count(*) AS meetings FROM meetings WHERE seen_at IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1",
}
