"""Looking up rooms and courses as people type them, against an index made from a timetable.

The index is three tables. ``buildings``: each building as the timetable writes it, with its place on the map by a cascade (equal name, equal key, first name that
begins with the key), whether it is elsewhere (campus of its first meeting), its meetings and rooms. ``rooms``: room and
building, home campus only, as other campuses number rooms in a space of their own. ``courses``: course and building, all campuses.

A query is answered by equi-joins on its squeezed lower-case form: building and room gives that room; a bare room gives a row for every building that has it;
a course a row for every building it is taught in, elsewhere last. A query that is both gives the room first. What is none of these gives no row.

Defined results: null and blank fields make no index rows; a null or blank query finds nothing; equal queries with different ids are each answered; an
empty timetable answers nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrant.functions.text import squeezed_key


def said(text: Column) -> Column:
    """Lower case, runs of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


@dataclass
class RoomIndex:
    buildings: DataFrame
    rooms: DataFrame
    courses: DataFrame


def match_registry(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, place, how) of each distinct ``name``: the registry's equal name, else the first of equal key, else the first whose key begins with it.

    registry: name, ordinal. Prefixes are met by an equi-join with the beginnings of the registry's keys.
    """
    known = registry.filter("name is not null").groupBy("name").agg(F.min("ordinal").alias("ordinal")).withColumn("key", squeezed_key(F.col("name"))).filter("key <> ''")
    keyed = known.groupBy("key").agg(F.min_by("name", "ordinal").alias("by_key"))
    begun = known.select("name", "ordinal", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    prefixed = begun.groupBy("key").agg(F.min_by("name", "ordinal").alias("by_prefix"))
    asked = names.select("name").filter("name is not null").distinct().withColumn("key", squeezed_key(F.col("name")))
    found = asked.join(known.select("name", F.col("name").alias("same")), "name", "left").join(keyed, "key", "left").join(prefixed, "key", "left")
    how = F.when(F.col("same").isNotNull(), "name").when(F.col("by_key").isNotNull(), "key").when(F.col("by_prefix").isNotNull(), "prefix")
    return found.select("name", F.coalesce("same", "by_key", "by_prefix").alias("place"), how.alias("how"))


def room_index(meetings: DataFrame, registry: DataFrame, home: str) -> RoomIndex:
    """meetings: meeting_id, course, title, campus, building, room; registry: name, ordinal, lon, lat."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    rows = meetings.select("meeting_id", clean("course").alias("course"), "title", "campus", clean("building").alias("building"), clean("room").alias("room")).filter("building is not null and room is not null")
    seen = rows.groupBy("building").agg(F.count(F.lit(1)).alias("meetings"), F.count_distinct("room").alias("room_count"), F.min_by("campus", "meeting_id").alias("campus"))
    placed = match_registry(seen.select(F.col("building").alias("name")), registry)
    at = registry.groupBy("name").agg(F.min_by(F.struct("lon", "lat"), "ordinal").alias("point"))
    buildings = (
        seen.join(placed.withColumnRenamed("name", "building"), "building", "left")
        .withColumn("elsewhere", ~F.col("campus").eqNullSafe(F.lit(home)))
        .withColumn("place", F.when(~F.col("elsewhere"), F.col("place")))
        .join(at.withColumnRenamed("name", "place"), "place", "left")
        .select("building", "campus", "elsewhere", "place", F.when(~F.col("elsewhere"), F.col("how")).alias("how"), "point", "meetings", "room_count")
    )
    told = buildings.select("building", "elsewhere", F.coalesce("place", "building").alias("shown"), "place", "point")
    rooms = rows.select("building", "room").distinct().join(told, "building").filter("not elsewhere")
    first = rows.filter("course is not null").groupBy("course").agg(F.min_by("title", "meeting_id").alias("title"))
    courses = rows.filter("course is not null").select("course", "building").distinct().join(first, "course").join(told, "building")
    return RoomIndex(buildings, rooms, courses)


def look_up(queries: DataFrame, index: RoomIndex) -> DataFrame:
    """(query_id, rank, place, name, description, elsewhere, point): the rows of each query, rank 0 rooms and 1 courses; queries: query_id, query."""
    asked = queries.select("query_id", said(F.col("query")).alias("key")).filter("key <> ''")
    rooms = index.rooms
    both = rooms.select("building", "room", "shown", "point", F.explode(F.array_distinct(F.array(said(F.concat_ws(" ", "building", "room")), said(F.concat_ws(" ", "shown", "room"))))).alias("key"))
    # Two spellings of one building are one answer.
    exact = both.groupBy("key", "shown").agg(F.min_by(F.struct("room", "point"), F.struct("building", "room")).alias("f")).select("key", "shown", F.col("f.room").alias("room"), F.col("f.point").alias("point"), F.lit(1).alias("of"))
    bare = rooms.groupBy(said(F.col("room")).alias("key"), "shown").agg(F.min_by(F.struct("room", "point"), F.struct("building", "room")).alias("f"))
    bare = bare.select("key", "shown", F.col("f.room").alias("room"), F.col("f.point").alias("point"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("of"))
    answers = exact.unionByName(bare).select(
        "key", F.lit(0).alias("rank"), F.col("shown").alias("place"), F.concat(F.lit("Room "), F.col("room")).alias("name"),
        F.when(F.col("of") > 1, F.concat_ws(" · ", "shown", F.concat(F.lit("one of "), F.col("of")))).otherwise(F.col("shown")).alias("description"), F.lit(False).alias("elsewhere"), "point",
    )
    taught = index.courses.groupBy(said(F.col("course")).alias("key"), "shown", "elsewhere").agg(F.min_by(F.struct("course", "title", "point"), F.struct("course", "building")).alias("f"))
    taught = taught.select(
        "key", F.lit(1).alias("rank"), F.col("shown").alias("place"), F.concat_ws(" — ", "f.course", "f.title").alias("name"),
        F.when(F.col("elsewhere"), F.concat(F.col("shown"), F.lit(" · not on this campus"))).otherwise(F.col("shown")).alias("description"), "elsewhere", F.when(~F.col("elsewhere"), F.col("f.point")).alias("point"),
    )
    return asked.join(answers.unionByName(taught), "key").drop("key")


def answers_in_order(found: DataFrame, most: int | None = None) -> DataFrame:
    """look_up's rows with their place in each answer: rooms before courses, home before elsewhere, then by name; the first ``most`` if given."""
    w = Window.partitionBy("query_id").orderBy("rank", "elsewhere", "place", "name")
    rows = found.withColumn("position", F.row_number().over(w))
    return rows if most is None else rows.filter(F.col("position") <= most)
