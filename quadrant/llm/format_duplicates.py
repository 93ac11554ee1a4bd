"""Records that differ only in formatting, collapsed to one each.

A record's canonical form keeps letters and digits only, in one case, with the free fields in sorted
order; its 128-bit hash is the grouping key. Counting is one aggregation with map-side combining, so
a record with billions of copies costs each task one row. A second, independent 64-bit value
stands in the key as well: records that share the 128-bit hash without being equal are kept apart, and
``hash_collisions`` counts them.

Defined results: null and empty fields are equal; a record that is empty in every free field is a record like
any other; combining marks count as punctuation; repeated rows are copies; an empty table gives no rows;
columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of all rows is hot. At most 1 / HOT_SHARE groups can be, which bounds the broadcast.
HOT_SHARE = 1 / 1000

FIELD_END = "\x1f"


def canonical_text(column: Column) -> Column:
    """Letters and digits of ``column`` in one case; null gives the empty text."""
    return F.upper(F.lower(F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"[^\p{L}\p{N}]", "")))


def canonical_record(frame: DataFrame, exact: list[str], free: list[str]) -> Column:
    """Canonical form: exact fields as they are, then the free fields' canonical texts in sorted order."""
    kept = [F.coalesce(frame[c].cast("string"), F.lit("")) for c in exact]
    loose = F.sort_array(F.array(*[canonical_text(frame[c]) for c in free]))
    return F.concat_ws(FIELD_END, *kept, F.array_join(loose, FIELD_END))


def keyed(frame: DataFrame, id_column: str, exact: list[str], free: list[str]) -> DataFrame:
    """(id, hash128, check64) of every row."""
    record = canonical_record(frame, exact, free)
    return frame.select(frame[id_column].alias("id"), record.alias("record")).select("id", F.unhex(F.md5("record")).alias("hash128"), F.xxhash64("record").alias("check64"))


def classes(rows: DataFrame) -> DataFrame:
    """(hash128, check64, first_id, copies) of every distinct record."""
    return rows.groupBy("hash128", "check64").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


def copies_of_first(frame: DataFrame, id_column: str, exact: list[str], free: list[str]) -> DataFrame:
    """(first_id, id) of every row that is not the first of its class.

    Rows of hot classes learn their first id from a broadcast of at most 1 / HOT_SHARE rows and are spread
    over the shuffle; all others meet their class in a join whose largest key is below HOT_SHARE.
    """
    rows = keyed(frame, id_column, exact, free)
    groups = classes(rows)
    total = groups.agg(F.sum("copies").alias("total"))
    hot = groups.join(F.broadcast(total)).filter(F.col("copies") > F.greatest(F.lit(10_000), F.col("total") * HOT_SHARE)).select("hash128", "check64", F.col("first_id").alias("hot_first"))
    marked = rows.join(F.broadcast(hot), ["hash128", "check64"], "left")
    spread = marked.select("id", "hot_first", F.when(F.col("hot_first").isNull(), F.col("hash128")).otherwise(F.unhex(F.md5(F.col("id").cast("string")))).alias("hash128"), "check64")
    several = groups.filter("copies > 1").select("hash128", "check64", "first_id")
    met = spread.join(several, ["hash128", "check64"], "left")
    first = F.coalesce("hot_first", "first_id")
    return met.select(first.alias("first_id"), "id").filter(F.col("first_id").isNotNull() & (F.col("id") != F.col("first_id")))


def distinct_records(frame: DataFrame, id_column: str, exact: list[str], free: list[str]) -> DataFrame:
    """One row per class: its first id, that row's fields as written, and the number of copies."""
    fields = [*exact, *free]
    rows = frame.select(frame[id_column].alias("id"), *fields, canonical_record(frame, exact, free).alias("record"))
    rows = rows.select("id", *fields, F.unhex(F.md5("record")).alias("hash128"), F.xxhash64("record").alias("check64"))
    grouped = rows.groupBy("hash128", "check64").agg(F.min(F.struct("id", *fields)).alias("kept"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(F.col("kept.id").alias("first_id"), *[F.col(f"kept.{c}") for c in fields], "copies")


def hash_collisions(frame: DataFrame, id_column: str, exact: list[str], free: list[str]) -> DataFrame:
    """(records, hashes, collided): distinct records, distinct 128-bit hashes, and how many records share a hash with another."""
    groups = classes(keyed(frame, id_column, exact, free))
    per_hash = groups.groupBy("hash128").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("collided"))
