"""Queries of names, phrases, classes and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions import naming, phrases, solar
from quadrant.functions.text import first_match, shortened
from quadrant.functions.units import stops, zoom_for_span
from quadrant.plans.features import expression
from quadrant.sources.tables import table

# The rules by which a name tells what a building is for; the first that matches.
USE_RULES = [
    (r"culinary|\bcafe\b|cafeteria|dining", "food"),
    (r"arts? (&|and) sci", "campus"),
    (r"gallery|theatre|theater|\bmusic\b|\barts\b", "arts"),
    (r"\bgym\b|\bpool\b|\bPE\b|physical education|athletic|kinesiology|baseball|softball", "sport"),
    (r"library|learning resource", "library"),
    (r"bookstore|college store", "store"),
    (r"police", "civic"),
    (r"child development", "childcare"),
    (r"parking garage", "parking"),
    (r"operations|sign shop|auto yard|ranch house|portable village|receiving|^rec\.?$|printing services", "works"),
]
USE_DEFAULT = "campus"
# Names that end so are ground, not buildings.
GROUND_NAME = r"(?i)\b(field|fields|courts|stadium|pool|track|lawn|quad|green|lot|yard|garden|grounds)\s*$"
LEAST_SOLID_M2 = 150
POINT, FLAT, SOLID = 0, 1, 2


def use_of(text: Column) -> Column:
    """What a building of a name is for; null without a name and for what is closed."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when((clean == "") | clean.rlike("(?i)^closed$"), F.lit(None)).otherwise(first_match(clean, USE_RULES, USE_DEFAULT))


def tier_of(name: Column, use: Column, label_kind: Column, area: Column) -> Column:
    """How much of a thing can be shown from above: solid, flat, or a point; by label kind, then area, then kind of label, then name, then use."""
    solid_uses = sorted({v for _, v in USE_RULES if v != "parking"} | {USE_DEFAULT})
    return (
        F.when(label_kind == "area", FLAT)
        .when(area.isNotNull(), F.when(area >= LEAST_SOLID_M2, SOLID).otherwise(FLAT))
        .when(label_kind.isin("building", "plate"), SOLID)
        .when(F.trim(name).rlike(GROUND_NAME), FLAT)
        .when(use == "parking", FLAT)
        .when(use.isin(*solid_uses), SOLID)
        .otherwise(POINT)
    )


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels", "label_id", "text", "kind", "area_m2")


def label_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by use and tier, with titles for areas and marks for car parks: numbers of each."""
    icon = F.when(F.col("kind") == "area", F.lit(None)).when(F.col("kind") == "parking", "parking").when(F.col("kind").isin("building", "plate"), use_of(F.col("text")))
    rows = _labels(spark, folder).withColumn("icon", icon).withColumn("tier", tier_of(F.col("text"), F.col("icon"), F.col("kind"), F.col("area_m2")))
    return rows.groupBy("kind", "icon", "tier").agg(F.count(F.lit(1)).alias("labels"), F.count(F.when(F.col("tier") >= SOLID, 1)).alias("flown"))


def directory_by_use(spark: SparkSession, folder: str) -> DataFrame:
    """The directory's names by use, sorted; every use is listed, empty ones too."""
    uses = [v for _, v in USE_RULES]
    listed = spark.createDataFrame([(u,) for u in dict.fromkeys([*uses, USE_DEFAULT])], "use string")
    rows = table(spark, folder, "directory", "name").withColumn("use", use_of(F.col("name")))
    found = rows.groupBy("use").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return listed.join(found, "use", "left").select("use", F.coalesce(F.array_join("names", "|"), F.lit("")).alias("names"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n"))


def uncovered_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Uses that no name of the directory has: the classes less those covered."""
    listed = spark.createDataFrame([(u,) for u in dict.fromkeys([v for _, v in USE_RULES] + [USE_DEFAULT])], "use string")
    return listed.subtract(table(spark, folder, "directory", "name").select(use_of(F.col("name")).alias("use")))


def tidied_names(spark: SparkSession, folder: str) -> DataFrame:
    """Roof names written as a drawing writes them (name, dash, abbreviation or part), tidied."""
    rows = table(spark, folder, "roofs", "name").filter("name is not null").distinct()
    initials = F.array_join(F.transform(F.filter(F.split("name", r"\s+"), lambda w: w.rlike("^[A-Z]")), lambda w: F.substring(w, 1, 1)), "")
    forms = F.array(F.col("name"), F.concat("name", F.lit(" (Rm 12)")), F.concat("name", F.lit(", Room 7b")), F.concat("name", F.lit(" Division")), F.concat("name", F.lit(" - "), initials), F.concat("name", F.lit(" - Annex of the East")))
    told = rows.select("name", F.posexplode(forms).alias("form", "raw"))
    return told.select("name", "form", naming.tidy_name(F.col("raw"), {"Hall - Old": "Hall"}).alias("tidied"))


def described(spark: SparkSession, folder: str) -> DataFrame:
    """For each directory entry, the one of its parts that agrees best with its official name, if one does so alone."""
    rows = table(spark, folder, "directory", "building_id", "official_name", "name", "parts").select("building_id", "official_name", F.explode(F.concat(F.array("name"), F.coalesce("parts", F.array().cast("array<string>")))).alias("part"))
    scored = rows.withColumn("score", naming.agreement(F.col("part"), F.col("official_name")))
    best = scored.groupBy("building_id").agg(F.max("score").alias("top"))
    top = scored.join(best, "building_id").filter("score = top and top > 0").groupBy("building_id", "top").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("part"))
    return top.select("building_id", F.col("top").cast("long").alias("score"), F.when(F.col("n") == 1, F.col("part")).alias("part"))


def same_words(spark: SparkSession, folder: str) -> DataFrame:
    """Directory entries whose words hold all of their official name's, or the other way round."""
    rows = table(spark, folder, "directory", "building_id", "name", "official_name")
    return rows.filter(naming.says_the_same(F.col("name"), F.col("official_name"))).select("building_id")


def titled(spark: SparkSession, folder: str) -> DataFrame:
    """Label texts in capitals, written as titles, and what joining their first two words as lines gives."""
    rows = table(spark, folder, "labels", "text").filter("text is not null").distinct()
    return rows.select("text", naming.title_case(F.upper("text")).alias("title"), naming.join_lines(F.slice(F.split("text", " "), 1, 2)).alias("joined"), shortened(F.concat_ws(" ", "text", "text", "text", "text"), 40).alias("short"))


def stripped_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of section cards as text: breaks kept, other markup and entities resolved."""
    rows = table(spark, folder, "section_cards", "card_id", "building").filter("building is not null")
    return rows.select("card_id", naming.plain_text(F.col("building"), "|").alias("text"))


def spoken_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals as feet of a route: time, arrival, distance, time left while walking, and whether it can be walked to."""
    feet = F.col("o_totalprice") / 10
    rows = table(spark, folder, "orders", "o_orderkey", "o_totalprice", "o_orderdate")
    summary = phrases.route_summary(feet, F.col("o_orderdate").cast("timestamp"))
    problem = phrases.reach_problem(feet / 40)
    return rows.withColumn("s", summary).select("o_orderkey", F.round("s.seconds", 4).alias("seconds"), "s.time", "s.arrival", "s.distance", phrases.nav_eta(feet).alias("eta"), problem.alias("problem"))


def instructions(spark: SparkSession, folder: str) -> DataFrame:
    """What is said for each kind of event, taken as a turn, and for fixes that failed."""
    kind = F.element_at(F.array(*[F.lit(k) for k in [*phrases.PHRASES, "fly"]]), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    rows = table(spark, folder, "events", "event_id").select(phrases.instruction(kind).alias("said"), phrases.location_problem(F.pmod("event_id", F.lit(4))).alias("problem"))
    return rows.groupBy("said", "problem").agg(F.count(F.lit(1)).alias("events"))


def building_notes(spark: SparkSession, folder: str) -> DataFrame:
    """What a card of each directory entry says: sub-title, floor area, height, position, numbers."""
    rows = table(spark, folder, "directory", "building_id", "name", "official_name", "parts", "area_m2", "height", "footprints", "anchor")
    inside = F.coalesce(F.greatest(F.size("parts"), F.lit(0)), F.lit(0))
    return rows.select(
        "building_id", phrases.building_sub(inside, F.coalesce("official_name", F.lit("")), F.col("name"), F.col("area_m2").cast("double")).alias("sub"), phrases.floor_area(F.col("area_m2").cast("double")).alias("area"),
        phrases.height_text(F.col("height")).alias("height"), phrases.place_label(F.round(F.get("anchor", F.lit(0)), 4), F.round(F.get("anchor", F.lit(1)), 4)).alias("at"), phrases.count_text(F.col("footprints"), inside, F.lit(0)).alias("counts"),
    )


#: Names of kinds of things, for those without a name of their own.
KIND_NAMES = {"defibrillator": "Defibrillator", "restroom": "All-gender restroom", "bike_rack": "Bike rack", "bus_stop": "Bus stop", "parking": "Parking", "drop_off": "Student drop-off"}


def shown_names(spark: SparkSession, folder: str) -> DataFrame:
    """What each amenity is called: its label, else the name of its kind, else "Marker"; the kind's name below it where it differs."""
    kind_name = phrases.lookup(F.col("kind"), KIND_NAMES, None)
    rows = table(spark, folder, "amenities", "kind", "label").select(F.coalesce("label", kind_name, F.lit("Marker")).alias("name"), F.when(kind_name != F.col("label"), kind_name).alias("sub"))
    return rows.groupBy("name", "sub").agg(F.count(F.lit(1)).alias("amenities"))


def glides(spark: SparkSession, folder: str) -> DataFrame:
    """Where drags end, by events taken as drags; and spans and zooms of views."""
    rows = table(spark, folder, "events", "event_id", "value").filter("value is not null")
    h, v, start = F.pmod(F.col("event_id") * 37, F.lit(800)).cast("double"), (F.pmod(F.col("event_id"), F.lit(21)) - 10) / 10.0, F.pmod(F.col("event_id") * 13, F.lit(800)).cast("double")
    span = phrases.framing_span(F.abs("value") * 20, F.lit(None).cast("double"), F.lit(None).cast("double"), 1.5, 0.8)
    return rows.select("event_id", phrases.detent(h, v, start, [90.0, 400.0, 720.0]).alias("stop"), F.round(span, 4).alias("span"), F.round(zoom_for_span(F.lit(390.0), F.lit(38.65), span), 6).alias("zoom"))


def sun_lights(spark: SparkSession, folder: str) -> DataFrame:
    """Lights of the sky when events happened, by whole degrees of the sun's height; and when to look again."""
    elevation, hour, declination = solar.sun_place(F.col("ts"), F.lit(-121.35), F.lit(38.65))
    azimuth = phrases.sun_azimuth(elevation, hour, declination, F.lit(38.65))
    rows = table(spark, folder, "events", "event_id", "ts").withColumn("l", phrases.sun_lights(elevation, azimuth)).withColumn("next", solar.next_check_ms(elevation))
    return rows.select("event_id", F.round("l.ambient", 5).alias("ambient"), F.round("l.direct", 5).alias("direct"), F.round("l.azimuth", 3).alias("azimuth"), F.round("l.polar", 4).alias("polar"), F.round("next", 0).alias("next_ms"))


SORTED = ["coalesce", ["get", "pt"], 0]


def drawing_order(spark: SparkSession, folder: str) -> DataFrame:
    """Labels in the order they are placed: the largest type first, then by id; rank within the kind."""
    w = Window.partitionBy("kind").orderBy((-expression(SORTED)), "label_id")
    return table(spark, folder, "labels", "label_id", "kind", "pt").select("label_id", F.row_number().over(w).alias("rank"), F.round(stops(expression(SORTED).cast("double"), [(4.0, 0.5), (9.0, 1.5), (14.0, 2.0)]), 6).alias("size"))


def labels_shown(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by kind that are shown with and without a category: while one is, neither car parks nor areas are."""
    rows = table(spark, folder, "labels", "label_id", "kind", "text")
    shown = lambda category: F.coalesce(F.col("text") != "closed", F.lit(False)) & (F.lit(not category) | ~F.coalesce(F.col("kind").isin("parking", "area"), F.lit(False)))
    return rows.groupBy("kind").agg(F.count(F.when(shown(False), 1)).alias("plain"), F.count(F.when(shown(True), 1)).alias("in_category"))


def height_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Roofs by what a drawing would make of them: kept or dropped by size and span, and the height they are given."""
    rows = table(spark, folder, "roofs", "area_m2", "cells", "name")
    span, curvy = F.sqrt("area_m2") / 3, F.pmod("cells", F.lit(3)) == 0
    keep = F.when(F.col("area_m2") >= 400, True).when(F.col("area_m2") >= 60, (span >= 3.5) & ~(F.coalesce(curvy, F.lit(False)) & (F.col("cells") > 40))).otherwise(False)
    height = F.when(F.col("name").rlike("(?i)pool"), 0).when(F.col("area_m2") < 200, 4).otherwise(9)
    return rows.filter("area_m2 is not null").groupBy(keep.alias("kept"), height.alias("height")).agg(F.count(F.lit(1)).alias("roofs"))


QUERIES = {f.__name__: f for f in (label_uses, directory_by_use, uncovered_uses, tidied_names, described, same_words, titled, stripped_cells, spoken_routes, instructions, building_notes, shown_names, glides, sun_lights, drawing_order, labels_shown, height_rule)}

_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'), ' ')"
_USE = "CASE WHEN " + _CLEAN + " = '' OR regexp_matches(" + _CLEAN + ", '^closed$', 'i') THEN NULL " + " ".join(f"WHEN regexp_matches({_CLEAN}, '{p}', 'i') THEN '{v}'" for p, v in USE_RULES) + " ELSE 'campus' END"
_USES = ", ".join(f"'{u}'" for u in dict.fromkeys([v for _, v in USE_RULES] + [USE_DEFAULT]))
_NICE = "CASE WHEN {0} >= 5280 THEN CAST(CAST(floor({0} / 5280 * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor({0} / 5280 * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' mi' WHEN {0} < 50 THEN CAST(CAST(greatest(floor({0} / 5 + 0.5) * 5, 0) AS BIGINT) AS VARCHAR) || ' ft' WHEN {0} < 500 THEN CAST(CAST(floor({0} / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) || ' ft' ELSE CAST(CAST(floor({0} / 50 + 0.5) * 50 AS BIGINT) AS VARCHAR) || ' ft' END"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z]+'), lambda w: len(w) >= 3)"
_SET = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z]+'), lambda w: w <> '' AND NOT list_contains(['and', 'the', 'of', 'at'], w)))"
_EVENT_TURN = "[" + ", ".join(f"'{v}'" for v in [*phrases.PHRASES.values(), "Continue"]) + "][event_id % 9 + 1]"
_TEXT = "regexp_replace(regexp_replace({0}, '<br\\s*/?>', '|', 'gi'), '<[^>]+>', '', 'g')"

ORACLES = {
    "label_uses": f"""WITH i AS (SELECT *, CASE WHEN kind = 'area' THEN NULL WHEN kind = 'parking' THEN 'parking' WHEN kind IN ('building', 'plate') THEN {_USE.format("text")} END AS icon FROM labels),
t AS (SELECT *, CAST(CASE WHEN kind = 'area' THEN 1 WHEN area_m2 IS NOT NULL THEN CASE WHEN area_m2 >= 150 THEN 2 ELSE 1 END WHEN kind IN ('building', 'plate') THEN 2
  WHEN regexp_matches(trim(text, ' '), '{GROUND_NAME.replace("(?i)", "")}', 'i') THEN 1 WHEN icon = 'parking' THEN 1 WHEN icon IS NOT NULL THEN 2 ELSE 0 END AS INTEGER) AS tier FROM i)
SELECT kind, icon, tier, count(*) AS labels, count(*) FILTER (WHERE tier >= 2) AS flown FROM t GROUP BY 1, 2, 3""",
    "directory_by_use": f"""WITH u AS (SELECT unnest([{_USES}]) AS use), d AS (SELECT {_USE.format("name")} AS use, name FROM directory)
SELECT u.use, coalesce(string_agg(name, '|' ORDER BY name), '') AS names, count(name) AS n FROM u LEFT JOIN d ON d.use = u.use GROUP BY 1""",
    "uncovered_uses": f"SELECT unnest([{_USES}]) AS use EXCEPT SELECT {_USE.format('name')} FROM directory",
    "described": f"""WITH p AS (SELECT building_id, official_name, unnest(list_concat([name], coalesce(parts, []))) AS part FROM directory),
s AS (SELECT building_id, part, len(list_filter({_WORDS.format("part")}, lambda w: len(list_filter({_WORDS.format("official_name")}, lambda a: starts_with(a, w) OR starts_with(w, a))) > 0)) AS score FROM p),
t AS (SELECT *, max(score) OVER (PARTITION BY building_id) AS top FROM s)
SELECT building_id, top AS score, CASE WHEN count(*) = 1 THEN min(part) END AS part FROM t WHERE score = top AND top > 0 GROUP BY 1, 2""",
    "same_words": f"""WITH s AS (SELECT building_id, {_SET.format("name")} AS a, {_SET.format("official_name")} AS b FROM directory)
SELECT building_id FROM s WHERE (len(a) > 0 AND len(list_intersect(a, b)) = len(a)) OR (len(b) > 0 AND len(list_intersect(a, b)) = len(b))""",
    "spoken_routes": f"""WITH f AS (SELECT o_orderkey, o_orderdate, o_totalprice / 10 AS feet FROM orders), s AS (SELECT *, feet / 3.28084 / 1.4 AS seconds, CAST(greatest(ceil(feet / 3.28084 / 84.0), 1) AS BIGINT) AS minutes, feet / 40 AS m, feet / 4.6 / 60 AS left_min FROM f),
k AS (SELECT *, m / 1000 * 0.621371 AS miles, m * 3.28084 AS mf FROM s)
SELECT o_orderkey, round(seconds, 4) AS seconds, CASE WHEN minutes < 60 THEN CAST(minutes AS VARCHAR) || ' min' ELSE CAST(minutes // 60 AS VARCHAR) || ' hr' || CASE WHEN minutes % 60 > 0 THEN ' ' || CAST(minutes % 60 AS VARCHAR) || ' min' ELSE '' END END AS time,
strftime(CAST(o_orderdate AS TIMESTAMP) + to_microseconds(CAST(floor(seconds * 1000000 + 0.5) AS BIGINT)), '%-I:%M %p') AS arrival, {_NICE.format("feet")} AS distance,
CASE WHEN left_min < 1 THEN '< 1 min' ELSE CAST(CAST(floor(left_min + 0.5) AS BIGINT) AS VARCHAR) || ' min' END AS eta,
CASE WHEN m > 300 THEN 'You are about ' || CASE WHEN miles >= 0.2 THEN CAST(CAST(floor(miles * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(miles * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' mi' ELSE {_NICE.format("mf")} END || ' from the campus paths — too far to walk from here. {phrases.HOLD}' END AS problem FROM k""",
    "instructions": f"""SELECT {_EVENT_TURN} AS said, CASE event_id % 4 WHEN 1 THEN 'Location is turned off for this site. Allow it in your browser, or press and hold the map to set a starting point.' WHEN 3 THEN 'Locating timed out. {phrases.HOLD}' ELSE 'Your device could not get a location fix. {phrases.HOLD}' END AS problem, count(*) AS events FROM events GROUP BY 1, 2""",
    "building_notes": """WITH d AS (SELECT *, coalesce(len(parts), 0) AS n, format('{:,}', CAST(floor(area_m2 * 10.7639 + 0.5) AS BIGINT)) || ' sq ft' AS sq FROM directory)
SELECT building_id, CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' destination inside' ELSE ' destinations inside' END WHEN coalesce(official_name, '') <> '' AND official_name <> name THEN official_name ELSE sq END AS sub, sq AS area,
CAST(floor(height * 3.28084 + 0.5) AS BIGINT) || ' ft' AS height, printf('%.4f', round(anchor[2], 4)) || ', ' || printf('%.4f', round(anchor[1], 4)) AS at,
concat_ws(' · ', CASE WHEN footprints > 0 THEN footprints || CASE WHEN footprints = 1 THEN ' building' ELSE ' buildings' END END, CASE WHEN n > 0 THEN n || CASE WHEN n = 1 THEN ' zone' ELSE ' zones' END END) AS counts FROM d""",
    "shown_names": f"""WITH k AS (SELECT label, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND_NAMES.items())} END AS kn FROM amenities) SELECT coalesce(label, kn, 'Marker') AS name, CASE WHEN kn <> label THEN kn END AS sub, count(*) AS amenities FROM k GROUP BY 1, 2""",
    "labels_shown": """SELECT kind, count(*) FILTER (WHERE text <> 'closed') AS plain, count(*) FILTER (WHERE text <> 'closed' AND coalesce(kind NOT IN ('parking', 'area'), true)) AS in_category FROM labels GROUP BY kind""",
    "drawing_order": """SELECT label_id, CAST(row_number() OVER (PARTITION BY kind ORDER BY -coalesce(pt, 0), label_id) AS INTEGER) AS rank, round(CASE WHEN coalesce(pt, 0) <= 4 THEN 0.5 WHEN coalesce(pt, 0) < 9 THEN 0.5 + (coalesce(pt, 0) - 4) / 5.0 WHEN coalesce(pt, 0) < 14 THEN 1.5 + (coalesce(pt, 0) - 9) / 5.0 * 0.5 ELSE 2.0 END, 6) AS size FROM labels""",
    "height_rule": """SELECT CASE WHEN area_m2 >= 400 THEN true WHEN area_m2 >= 60 THEN sqrt(area_m2) / 3 >= 3.5 AND NOT (coalesce(cells % 3 = 0, false) AND cells > 40) ELSE false END AS kept, CAST(CASE WHEN regexp_matches(name, 'pool', 'i') THEN 0 WHEN area_m2 < 200 THEN 4 ELSE 9 END AS INTEGER) AS height, count(*) AS roofs FROM roofs WHERE area_m2 IS NOT NULL GROUP BY 1, 2""",
    "titled": """WITH t AS (SELECT DISTINCT text FROM labels WHERE text IS NOT NULL), l AS (SELECT text, string_split(text, ' ') AS w, concat_ws(' ', text, text, text, text) AS four FROM t)
SELECT text, array_to_string(list_transform(regexp_extract_all(upper(text), '(\\p{Lu}[\\p{Lu}'']*|[^\\p{Lu}]+)'), lambda p: CASE WHEN regexp_full_match(p, '\\p{Lu}[\\p{Lu}'']*') THEN p[1] || lower(p[2:]) ELSE p END), '') AS title,
CASE WHEN len(w) >= 2 AND regexp_matches(w[2], '^[a-z]') THEN w[1] || w[2] ELSE array_to_string(w[1:2], ' ') END AS joined,
CASE WHEN length(four) > 40 THEN rtrim(four[1:40], ' ') || '…' ELSE four END AS short FROM l""",
    "stripped_cells": f"""WITH t AS (SELECT card_id, replace(replace({_TEXT.format("building")}, '&nbsp;', ' '), '&amp;', '&') AS t FROM section_cards WHERE building IS NOT NULL),
c AS (SELECT card_id, array_to_string(list_transform(regexp_extract_all(t, '(?s)(&#\\d+;|&|[^&]+)'), lambda p: CASE WHEN regexp_full_match(p, '&#\\d+;') THEN chr(CAST(regexp_extract(p, '\\d+') AS INTEGER)) ELSE p END), '') AS t FROM t)
SELECT card_id, trim(regexp_replace(regexp_replace(t, '&[a-z]+;', ' ', 'g'), '[\\s]+', ' ', 'g'), ' ') AS text FROM c""",
    "glides": """WITH d AS (SELECT event_id, value, CAST((event_id * 37) % 800 AS DOUBLE) AS h, (event_id % 21 - 10) / 10.0 AS v, CAST((event_id * 13) % 800 AS DOUBLE) AS s FROM events WHERE value IS NOT NULL),
e AS (SELECT *, [90.0, 400.0, 720.0] AS st, unnest([1, 2, 3]) AS i FROM d),
n AS (SELECT event_id, any_value(value) AS value, any_value(v) AS v, arg_min(i, abs(st[i] - (h + v * 120)) * 1000 + i / 1000.0) AS target, arg_min(i, abs(st[i] - s) * 1000 + i / 1000.0) AS origin FROM e GROUP BY event_id),
f AS (SELECT *, greatest(130.0, least(800.0, sqrt(greatest(abs(value) * 20, 150.0)) / 2 * 1.5 / 0.8)) AS span FROM n)
SELECT event_id, CAST([90.0, 400.0, 720.0][CASE WHEN abs(v) >= 0.45 AND target = origin THEN least(greatest(origin + CASE WHEN v > 0 THEN 1 ELSE -1 END, 1), 3) ELSE target END] AS DOUBLE) AS stop, round(span, 4) AS span,
round(log2(390.0 * 156543.03392 * cos(radians(38.65)) / span), 6) AS zoom FROM f""",
}
