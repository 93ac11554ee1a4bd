"""Room and course search over the timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.operators.room_lookup import RoomIndex, answers_in_order, look_up, match_registry, room_index
from quadrant.sources.tables import table

HOME = "Hillside Campus"
#: A search shows at most so many rooms.
MOST = 6


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Names with places: the directory in the order of its ids."""
    directory = table(spark, folder, "directory", "building_id", "name", "anchor").select(F.col("building_id").alias("ordinal"), "name", F.get("anchor", F.lit(0)).alias("lon"), F.get("anchor", F.lit(1)).alias("lat"))
    return directory.filter("lon is not null and lat is not null")


def index_of(spark: SparkSession, folder: str) -> RoomIndex:
    meetings = table(spark, folder, "meetings", "meeting_id", "course", "title", "campus", "building", "room")
    return room_index(meetings, registry(spark, folder), HOME)


def room_buildings(spark: SparkSession, folder: str) -> DataFrame:
    """The buildings of the timetable: place on the map and how it was found, meetings, distinct rooms, elsewhere or not."""
    return index_of(spark, folder).buildings.select("building", "campus", "elsewhere", "place", "how", F.round("point.lon", 7).alias("lon"), F.round("point.lat", 7).alias("lat"), "meetings", "room_count")


def room_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Each room of the home campus with its buildings."""
    rooms = index_of(spark, folder).rooms
    return rooms.groupBy("room").agg(F.array_join(F.sort_array(F.collect_set("building")), "|").alias("buildings"), F.count_distinct("building").alias("n"))


def course_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Each course with its first title and its buildings."""
    courses = index_of(spark, folder).courses
    return courses.groupBy("course", "title").agg(F.array_join(F.sort_array(F.collect_set("building")), "|").alias("buildings"), F.count(F.when(F.col("elsewhere"), 1)).alias("elsewhere"))


def _asked(spark: SparkSession, folder: str, what: str) -> DataFrame:
    rows = table(spark, folder, "meetings", "course", "building", "room")
    text = {"room": F.col("room"), "course": F.lower("course"), "both": F.concat_ws("  ", F.upper("building"), "room")}[what]
    wanted = rows.filter("building is not null and room is not null" if what == "both" else f"{what} is not null")
    return wanted.select(text.alias("query")).distinct().withColumn("query_id", F.col("query"))


def _answers(spark: SparkSession, folder: str, what: str, most: int | None = None) -> DataFrame:
    found = answers_in_order(look_up(_asked(spark, folder, what), index_of(spark, folder)), most)
    return found.select(F.col("query_id").alias("query"), "position", "rank", "place", "name", "description", "elsewhere", F.col("point").isNotNull().alias("placed"))


def room_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every room number of the timetable, looked up: a row a building, ``one of N`` where there are several; the first six."""
    return _answers(spark, folder, "room", MOST)


def course_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every course of the timetable, looked up: a row a building, other campuses last."""
    return _answers(spark, folder, "course")


def building_room_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every building-and-room of the timetable as shouted with two spaces, looked up."""
    return _answers(spark, folder, "both")


def name_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """The building that each name of a roof means by equal name, key or beginning, and which of these it was."""
    names = table(spark, folder, "roofs", "name")
    return match_registry(names, registry(spark, folder))


QUERIES = {f.__name__: f for f in (room_buildings, room_sets, course_sets, room_search, course_search, building_room_search, name_cascade)}

_K = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_C = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '), '')"
_S = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"
_REGISTRY = "g AS (SELECT building_id AS ordinal, name, anchor[1] AS lon, anchor[2] AS lat, " + _K.format("name") + " AS key FROM directory WHERE name IS NOT NULL AND anchor[1] IS NOT NULL AND anchor[2] IS NOT NULL)"


def _cascade(names: str) -> str:
    return f"""n AS (SELECT DISTINCT name, {_K.format("name")} AS key FROM ({names}) WHERE name IS NOT NULL),
c AS (SELECT n.name, coalesce((SELECT min(g.name) FROM g WHERE g.name = n.name), (SELECT arg_min(g.name, g.ordinal) FROM g WHERE g.key = n.key AND g.key <> ''), (SELECT arg_min(g.name, g.ordinal) FROM g WHERE n.key <> '' AND starts_with(g.key, n.key))) AS place,
  CASE WHEN (SELECT count(*) FROM g WHERE g.name = n.name) > 0 THEN 'name' WHEN (SELECT count(*) FROM g WHERE g.key = n.key AND g.key <> '') > 0 THEN 'key'
  WHEN (SELECT count(*) FROM g WHERE n.key <> '' AND starts_with(g.key, n.key)) > 0 THEN 'prefix' END AS how FROM n)"""


_INDEX = f"""WITH {_REGISTRY},
m AS (SELECT meeting_id, {_C.format("course")} AS course, title, campus, {_C.format("building")} AS building, {_C.format("room")} AS room FROM meetings WHERE {_C.format("building")} IS NOT NULL AND {_C.format("room")} IS NOT NULL),
b AS (SELECT building, count(*) AS meetings, count(DISTINCT room) AS room_count, arg_min_null(campus, meeting_id) AS campus FROM m GROUP BY building),
{_cascade("SELECT building AS name FROM b")},
t AS (SELECT b.building, b.campus, b.campus IS DISTINCT FROM '{HOME}' AS elsewhere, CASE WHEN b.campus = '{HOME}' THEN c.place END AS place, CASE WHEN b.campus = '{HOME}' THEN c.how END AS how, meetings, room_count FROM b LEFT JOIN c ON c.name = b.building),
bl AS (SELECT t.*, g.lon, g.lat, coalesce(t.place, t.building) AS shown FROM t LEFT JOIN g ON g.name = t.place),
r AS (SELECT DISTINCT m.building, m.room, bl.shown, bl.lon FROM m JOIN bl ON bl.building = m.building WHERE NOT elsewhere),
co AS (SELECT course, arg_min_null(title, meeting_id) AS title FROM m WHERE course IS NOT NULL GROUP BY course),
k AS (SELECT DISTINCT m.course, co.title, m.building, bl.shown, bl.elsewhere, bl.lon FROM m JOIN co ON co.course = m.course JOIN bl ON bl.building = m.building)"""


def answered(asked: str, most: int | None = None, first: str | None = None) -> str:
    """WITH clauses up to ``found``, the answers to the queries of a SELECT; ``first`` is a clause that stands before them."""
    index = _INDEX if first is None else _INDEX.replace("WITH ", f"WITH {first}, ", 1)
    return f"""{index},
e AS (SELECT DISTINCT {_S.format("building || ' ' || room")} AS key, shown, room, lon, building FROM r UNION SELECT DISTINCT {_S.format("shown || ' ' || room")}, shown, room, lon, building FROM r),
ex AS (SELECT key, shown, arg_min(room, building || chr(1) || room) AS room, max(lon) AS lon, 1 AS n FROM e GROUP BY key, shown),
ba AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM (SELECT {_S.format("room")} AS key, shown, arg_min(room, building || chr(1) || room) AS room, max(lon) AS lon FROM r GROUP BY 1, 2)),
an AS (SELECT key, 0 AS rank, shown AS place, 'Room ' || room AS name, CASE WHEN n > 1 THEN shown || ' · one of ' || n ELSE shown END AS description, false AS elsewhere, lon IS NOT NULL AS placed FROM (SELECT * FROM ex UNION ALL SELECT key, shown, room, lon, n FROM ba)
  UNION ALL SELECT {_S.format("course")}, 1, shown, arg_min(concat_ws(' — ', course, title), course || chr(1) || building), CASE WHEN elsewhere THEN shown || ' · not on this campus' ELSE shown END, elsewhere, max(lon) IS NOT NULL AND NOT elsewhere FROM k GROUP BY 1, shown, elsewhere),
q AS (SELECT DISTINCT query, {_S.format("query")} AS key FROM ({asked})),
every AS (SELECT q.query, CAST(row_number() OVER (PARTITION BY q.query ORDER BY rank, elsewhere, place, name) AS INTEGER) AS position, rank, place, name, description, elsewhere, placed FROM q JOIN an ON an.key = q.key WHERE q.key <> ''),
found AS (SELECT * FROM every {f"WHERE position <= {most}" if most else ""})"""


def _answered(asked: str, most: int | None = None) -> str:
    return f"{answered(asked, most)} SELECT * FROM found"


ORACLES = {
    "room_buildings": f"{_INDEX} SELECT building, campus, elsewhere, place, how, round(lon, 7) AS lon, round(lat, 7) AS lat, meetings, room_count FROM bl",
    "room_sets": f"{_INDEX} SELECT room, array_to_string(list_sort(list(DISTINCT building)), '|') AS buildings, count(DISTINCT building) AS n FROM r GROUP BY room",
    "course_sets": f"{_INDEX} SELECT course, title, array_to_string(list_sort(list(DISTINCT building)), '|') AS buildings, count(*) FILTER (WHERE elsewhere) AS elsewhere FROM k GROUP BY 1, 2",
    "room_search": _answered("SELECT room AS query FROM meetings WHERE room IS NOT NULL", MOST),
    "course_search": _answered("SELECT lower(course) AS query FROM meetings WHERE course IS NOT NULL"),
    "building_room_search": _answered("SELECT upper(building) || '  ' || room AS query FROM meetings WHERE building IS NOT NULL AND room IS NOT NULL"),
    "name_cascade": f"WITH {_REGISTRY}, {_cascade('SELECT name FROM roofs')} SELECT name, place, how FROM c",
}
