"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.llm import byte_bpe, canonical_values, format_duplicates, line_kinds, soft_linkage, suffix_leaks
from quadrant.sources.tables import table

MEETING_EXACT, MEETING_FREE = ["course", "section", "campus"], ["building", "room"]


def _meetings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "meetings", "meeting_id", *MEETING_EXACT, *MEETING_FREE)


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Label-roof pairs with some evidence, with their confidence."""
    labels = table(spark, folder, "labels", "label_id", "text", "lon", "lat", "area_m2")
    labels = labels.select(F.col("label_id").alias("id"), "text", "lon", "lat", F.col("area_m2").cast("double").alias("area"))
    roofs = table(spark, folder, "roofs")
    same = F.xxhash64("name", "area_m2", "cells", "roof_m", "ground_m", F.col("centre").cast("string"))
    place = [F.when(F.size("centre") >= 2, F.element_at("centre", i)) for i in (1, 2)]
    roofs = roofs.select(F.col("roof_id").alias("id"), "name", place[0].alias("lon"), place[1].alias("lat"), F.col("area_m2").cast("double").alias("area"), same.alias("thing"))
    return soft_linkage.link(spark, labels, roofs).withColumnsRenamed({"left_id": "label_id", "right_id": "roof_id", "s": "evidence"})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The label-roof pairs of the same building."""
    return soft_linkage.matches(p1_links(spark, folder)).select("label_id", "roof_id")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    directory = table(spark, folder, "directory", "building_id", "name", "official_name")
    meetings = table(spark, folder, "meetings", "meeting_id", "building")
    labels = table(spark, folder, "labels", "label_id", "text")
    named = [canonical_values.match_values(meetings, "meeting_id", "building", directory).withColumn("tbl", F.lit("meetings")), canonical_values.match_values(labels, "label_id", "text", directory).withColumn("tbl", F.lit("labels"))]
    return named[0].unionByName(named[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The directory entry that each freely written building name means, or -1."""
    return _named(spark, folder).select("tbl", "row_id", F.col("entry").alias("building_id"))


def p2_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the values that mean no entry: each with its number of rows."""
    return _named(spark, folder).filter(F.col("entry") == canonical_values.NONE).groupBy("tbl", "value").agg(F.count(F.lit(1)).alias("rows"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every meeting that repeats an earlier one but for formatting, with the first one's id."""
    return format_duplicates.copies_of_first(_meetings(spark, folder), "meeting_id", MEETING_EXACT, MEETING_FREE).withColumnRenamed("id", "meeting_id")


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per meeting and the number of its copies."""
    return format_duplicates.distinct_records(_meetings(spark, folder), "meeting_id", MEETING_EXACT, MEETING_FREE)


def p4_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """The collision check of the 128-bit hashes."""
    return format_duplicates.hash_collisions(_meetings(spark, folder), "meeting_id", MEETING_EXACT, MEETING_FREE)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return byte_bpe.encode_corpus(table(spark, folder, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the held-out items that leaked into it."""
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks with the words covered, the longest verbatim match and where in the document it begins."""
    return suffix_leaks.find_leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source, before and after those with leaks are removed."""
    documents = table(spark, folder, "documents", "doc_id", "source")
    kept = suffix_leaks.without_leaks(documents, p7_leaks(spark, folder))
    before = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    after = kept.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return before.join(after, before["source"].eqNullSafe(after["s"]), "left").select("source", "documents", F.coalesce("n", F.lit(0)).alias("kept"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are mostly list, table or junk."""
    return p8_kinds(spark, folder).filter("kind is not null").select("doc_id", "kind")


def p8_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of prose, list, table and junk of every document, and its kind if prose has less than a quarter."""
    return line_kinds.label_documents(table(spark, folder, "documents", "doc_id", "text"))


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics of every document."""
    return line_kinds.text_statistics(table(spark, folder, "documents", "doc_id", "text"))


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_misses": p2_misses, "p4_found": p4_found, "p4_records": p4_records, "p4_collisions": p4_collisions, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_clean": p7_clean, "p8_found": p8_found, "p8_kinds": p8_kinds, "p8_stats": p8_stats}

_CANON = r"upper(lower(regexp_replace(coalesce({0}, ''), '[^\p{{L}}\p{{N}}]', '', 'g')))"
_KEYED = f"""
WITH c AS (SELECT meeting_id, coalesce(course, '') AS course, coalesce(section, '') AS section, coalesce(campus, '') AS campus, building, room,
                  {_CANON.format("building")} AS x, {_CANON.format("room")} AS y FROM meetings),
k AS (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi FROM c)"""

ORACLES = {
    "p4_found": f"""{_KEYED},
f AS (SELECT meeting_id, min(meeting_id) OVER (PARTITION BY course, section, campus, lo, hi) AS first_id FROM k)
SELECT first_id, meeting_id FROM f WHERE meeting_id <> first_id""",
    "p4_records": f"""{_KEYED},
f AS (SELECT min(meeting_id) AS first_id, count(*) AS copies FROM k GROUP BY course, section, campus, lo, hi)
SELECT first_id, m.course, m.section, m.campus, m.building, m.room, copies FROM f JOIN meetings m ON m.meeting_id = f.first_id""",
    "p4_collisions": f"""{_KEYED},
f AS (SELECT course, section, campus, lo, hi FROM k GROUP BY course, section, campus, lo, hi)
SELECT count(*) AS records, count(*) AS hashes, CAST(0 AS BIGINT) AS collided FROM f""",
    "p8_stats": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\r\n]+'), lambda x: x <> '') AS w,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\r\n]+'), lambda x: regexp_matches(x, '[^ \t]')) AS l FROM documents),
d AS (
  SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS dense, length(regexp_replace(array_to_string(w, ''), '[\p{L}\p{N}]', '', 'g')) AS symbols,
         len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?] *\z'))) AS ended, len(list_filter(w, lambda x: list_contains(["""
    + ", ".join(f"'{w}'" for w in sorted(line_kinds.COMMON))
    + """], x))) AS common FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS words, CAST(dense AS DOUBLE) / nullif(n, 0) AS mean_word, CAST(symbols AS DOUBLE) / nullif(dense, 0) AS symbol_ratio,
       CAST(ended AS DOUBLE) / nullif(lines, 0) AS ended_lines, CAST(common AS DOUBLE) / nullif(n, 0) AS common_words FROM d""",
}
