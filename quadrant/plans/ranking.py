"""Search ranking and popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions.text import ascii_key, folded_key
from quadrant.functions.units import bonus_for
from quadrant.operators.room_lookup import answers_in_order, look_up
from quadrant.plans import rooms
from quadrant.plans.rooms import index_of
from quadrant.sources.tables import table

TOP = 8
#: Score of a term by how it meets a name: equal, first word(s), start of a word, inside, only in the description.
BANDS = (100, 80, 60, 35, 12)
HALF_LIFE_DAYS = 21.0
NAME_QUERIES = ["library", "hall", "north", "portable village", "studio art", "center", "the", ""]
PART_QUERIES = ["small ring", "red", "economy", "gear hot", "bolt", "widget", "idge", ""]
DOC_QUERIES = ["court", "office", "map room", "north", "the building", "level stairs", "class", ""]
TEXT_QUERIES = ["north wing", "tower", "basement level", "court", "office"]


def term_score(name: Column, full: Column, term: Column) -> Column:
    """The band in which a term meets an entry, 0 if it does not."""
    equal, first, word, inside, described = (F.lit(b) for b in BANDS)
    padded = F.concat(F.lit(" "), name)
    return F.when(name == term, equal).when(name.startswith(F.concat(term, F.lit(" "))), first).when(padded.contains(F.concat(F.lit(" "), term)), word).when(name.contains(term), inside).when(full.contains(term), described).otherwise(0)


def rank(index: DataFrame, queries: list[str], bonus: Column | None = None, top: int = TOP) -> DataFrame:
    """(query, place, ordinal, score): the best entries of each query.

    index: ordinal, name (a key), full (a key that holds name and description). Every term must score. The queries are literals in
    the plan: each row of the index is scored against them in one pass, and only rows with a score go on to the ranking. A query without
    terms finds nothing.
    """
    asked = [(q, terms) for q in queries if (terms := ascii_terms(q))]
    scored = []
    for text, terms in asked:
        each = [term_score(F.col("name"), F.col("full"), F.lit(t)) for t in terms]
        total = sum(each[1:], each[0])
        least = F.least(*each) if len(each) > 1 else each[0]
        scored.append(F.struct(F.lit(text).alias("query"), F.when(least > 0, total).alias("total")))
    rows = index.withColumn("hit", F.explode(F.filter(F.array(*scored), lambda h: h["total"].isNotNull())))
    score = F.col("hit.total") + (bonus if bonus is not None else F.lit(0.0)) - F.length("name") / 1000
    rows = rows.select(F.col("hit.query").alias("query"), "ordinal", F.round(score, 6).alias("score"))
    # Spark keeps only the first rows of each window partition before it shuffles (window group limit).
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ordinal"))
    return rows.withColumn("place", place).filter(F.col("place") <= top)


#: Queries asked at once, broadcast: their number is checked.
MAX_QUERIES = 10_000


def rank_asked(index: DataFrame, queries: DataFrame, top: int | None = TOP) -> DataFrame:
    """(query_id, place, ordinal, score): the best entries of each row of a table of queries (query_id, query).

    index: ordinal, name, full, bonus. The queries are a set of checked size against all rows: each entry is scored once against each, within the scan, and only
    entries in which every term scores go on; the ranking keeps the first rows of a query before it shuffles. A query without terms finds nothing.
    """
    asked = queries.select("query_id", F.split(ascii_key(F.col("query")), " ").alias("terms")).filter("terms[0] <> ''")
    if asked.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries at once; ask in parts")
    met = index.join(F.broadcast(asked), F.forall("terms", lambda t: F.col("full").contains(t)))
    each = F.transform("terms", lambda t: term_score(F.col("name"), F.col("full"), t))
    total = F.aggregate(each, F.lit(0), lambda a, b: F.when((a < 0) | (b == 0), -1).otherwise(a + b))
    scored = met.withColumn("total", total).filter("total > 0")
    rows = scored.select("query_id", "ordinal", F.round(F.col("total") + F.col("bonus") - F.length("name") / 1000, 6).alias("score"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")))
    return placed if top is None else placed.filter(F.col("place") <= top)


def prominence(inside: Column) -> Column:
    """min(1, ln(1 + n) / ln 13) of the number of things inside; null where there are none."""
    return F.when(inside > 0, F.least(F.lit(1.0), F.log1p(inside.cast("double")) / F.log1p(F.lit(12.0))))


def searched(rooms: DataFrame, places: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, position, section, entry, score): rooms first, then ranked places, ``top`` of both; a query without terms keeps its rooms uncut.

    rooms: query_id, position, entry; places: query_id, place, entry, score.
    """
    blank = queries.select("query_id", (ascii_key(F.col("query")) == "").alias("blank"))
    parts = rooms.select("query_id", F.lit(0).alias("section"), F.col("position").alias("at"), "entry", F.lit(None).cast("double").alias("score"))
    both = parts.unionByName(places.select("query_id", F.lit(1).alias("section"), F.col("place").alias("at"), "entry", "score"))
    numbered = both.join(F.broadcast(blank), "query_id").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("section", "at")))
    return numbered.filter(F.col("blank") | (F.col("position") <= top)).select("query_id", "position", "section", "entry", "score")


#: Words of the phrase whose parts stand for the asker's own position.
HERE_PHRASE, HERE = "your location here me current", "Your location"


def with_here(found: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """searched() with the asker's own position first where the query is empty, part of HERE_PHRASE or begins with "you"; cut to ``top`` again."""
    key = ascii_key(F.col("query"))
    wants = queries.filter((key == "") | F.lit(HERE_PHRASE).contains(key) | key.startswith("you")).select("query_id")
    row = wants.select("query_id", F.lit(0).alias("position"), F.lit(-1).alias("section"), F.lit(HERE).alias("entry"), F.lit(None).cast("double").alias("score"))
    marked = found.join(F.broadcast(wants.withColumn("w", F.lit(True))), "query_id", "left").unionByName(row.withColumn("w", F.lit(True)))
    placed = marked.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("section", "position")))
    return placed.filter(F.col("w").isNull() | (F.col("position") <= top)).drop("w")


def ascii_terms(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def name_rank_top8(spark: SparkSession, folder: str) -> DataFrame:
    """The best directory entries for each of a list of queries."""
    rows = table(spark, folder, "directory", "building_id", "name", "official_name")
    index = rows.select(F.col("building_id").alias("ordinal"), ascii_key(F.col("name")).alias("name"), ascii_key(F.concat_ws(" ", "name", "official_name")).alias("full"))
    return rank(index, NAME_QUERIES)


def folded_rank_top8(spark: SparkSession, folder: str) -> DataFrame:
    """name_rank_top8 over all names with compatibility folding and parts as descriptions."""
    rows = table(spark, folder, "directory", "building_id", "name", "parts")
    index = rows.select(F.col("building_id").alias("ordinal"), folded_key(F.col("name")).alias("name"), folded_key(F.concat_ws(" ", "name", "parts")).alias("full"))
    return rank(index, TEXT_QUERIES)


def part_rank_top8(spark: SparkSession, folder: str) -> DataFrame:
    """The best parts for each of a list of queries, their types as descriptions."""
    rows = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    return rank(rows.select(F.col("p_partkey").alias("ordinal"), ascii_key(F.col("p_name")).alias("name"), ascii_key(F.concat_ws(" ", "p_name", "p_type")).alias("full")), PART_QUERIES)


def doc_rank_top8(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for each of a list of queries: the first line is the name, the whole text the description."""
    rows = table(spark, folder, "documents", "doc_id", "text")
    return rank(rows.select(F.col("doc_id").alias("ordinal"), ascii_key(F.substring_index("text", "\n", 1)).alias("name"), ascii_key(F.col("text")).alias("full")), DOC_QUERIES)


SEARCHES = ["library", "hall", "north", "portable village", "studio art", "the", "", "you", "current", "101", "room", "east wing", "math"]


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(SEARCHES)], "query_id long, query string")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """The directory as a search index with the bonus of its prominence."""
    rows = table(spark, folder, "directory", "building_id", "name", "official_name", "parts")
    bonus = bonus_for(F.coalesce(prominence(F.coalesce(F.greatest(F.size("parts"), F.lit(0)), F.lit(0))), F.lit(0.0)))
    return rows.select(F.col("building_id").alias("ordinal"), F.col("name").alias("entry"), ascii_key(F.col("name")).alias("name"), ascii_key(F.concat_ws(" ", "name", "official_name")).alias("full"), bonus.alias("bonus"))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    asked, index = _asked(spark), _entries(spark, folder)
    in_rooms = answers_in_order(look_up(asked, index_of(spark, folder)), TOP - 2).select("query_id", "position", F.concat_ws(", ", "name", "place").alias("entry"))
    places = rank_asked(index, asked).join(F.broadcast(index.select("ordinal", "entry")), "ordinal").select("query_id", "place", "entry", "score")
    return searched(in_rooms, places, asked)


def search_top8(spark: SparkSession, folder: str) -> DataFrame:
    """The best eight of rooms and buildings for each row of a table of queries; buildings with many parts have a bonus."""
    return _found(spark, folder)


def search_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    """search_top8 with the asker's own position offered first where the query may mean it."""
    return with_here(_found(spark, folder), _asked(spark))


def prominent_names(spark: SparkSession, folder: str) -> DataFrame:
    """Prominence of the directory's buildings that have parts."""
    rows = table(spark, folder, "directory", "name", "parts").filter("size(parts) > 0")
    return rows.select("name", F.round(prominence(F.size("parts")), 9).alias("weight"))


def popular_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The six most popular names that the search index knows, in their order: label texts by how often they are printed, then prominent buildings."""
    visited = table(spark, folder, "labels", "text").filter("text is not null").groupBy(F.col("text").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    listed = table(spark, folder, "directory", "name").withColumn("listed", F.lit(True))
    names = visited.select("name", F.lit(0).alias("shelf"), "w").unionByName(prominent_names(spark, folder).select("name", F.lit(1).alias("shelf"), F.col("weight").alias("w")))
    once = names.groupBy("name").agg(F.min(F.struct("shelf", (-F.col("w")).alias("o"))).alias("k"))
    known = once.join(listed, "name").select("name", F.col("k.shelf").alias("shelf"), (-F.col("k.o")).alias("w"))
    return known.orderBy("shelf", F.desc("w"), "name").limit(TOP - 2)


def visit_weights(events: DataFrame, name: Column, at: Column, now: Column) -> DataFrame:
    """(name, weight): visits that count half after each half-life."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000
    return events.select(name.alias("name"), F.pow(F.lit(0.5), days / HALF_LIFE_DAYS).alias("w")).groupBy("name").agg(F.sum("w").alias("weight"))


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "ts", "user_id", "event_type").filter("event_type in ('view', 'purchase')")
    last = events.agg(F.max("ts").alias("now"))
    return visit_weights(events.join(F.broadcast(last)), F.col("user_id"), F.col("ts"), F.col("now"))


def popular_decay(spark: SparkSession, folder: str) -> DataFrame:
    """Decayed visits of each user."""
    return _weights(spark, folder).select(F.col("name").alias("user_id"), F.round("weight", 6).alias("weight"))


def popular_bonus(spark: SparkSession, folder: str) -> DataFrame:
    """The bounded bonus that decayed visits give."""
    return _weights(spark, folder).select(F.col("name").alias("user_id"), F.round(bonus_for(F.col("weight")), 6).alias("bonus"))


def popular_shelf(spark: SparkSession, folder: str) -> DataFrame:
    """Six to offer: the most visited users first, then those with the largest single value, each once."""
    visited = _weights(spark, folder).select(F.lit(0).alias("shelf"), F.col("name").alias("user_id"), F.round("weight", 6).alias("w"))
    prominent = table(spark, folder, "events", "user_id", "value").groupBy("user_id").agg(F.round(F.max("value"), 6).alias("w")).select(F.lit(1).alias("shelf"), "user_id", "w")
    # Six of each are enough for six in all.
    tops = [d.orderBy(F.desc("w"), "user_id").limit(12) for d in (visited, prominent)]
    once = tops[0].unionByName(tops[1]).groupBy("user_id").agg(F.min(F.struct("shelf", (-F.col("w")).alias("o"))).alias("k"))
    return once.select("user_id", F.col("k.shelf").alias("shelf"), (-F.col("k.o")).alias("w")).orderBy("shelf", F.desc("w"), "user_id").limit(6)


QUERIES = {f.__name__: f for f in (name_rank_top8, folded_rank_top8, part_rank_top8, doc_rank_top8, popular_decay, popular_bonus, popular_shelf, search_top8, search_suggestions, prominent_names, popular_entries)}

_ASCII = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
_TERM = "CASE WHEN name = t THEN 100 WHEN starts_with(name, t || ' ') THEN 80 WHEN contains(' ' || name, ' ' || t) THEN 60 WHEN contains(name, t) THEN 35 WHEN contains(\"full\", t) THEN 12 ELSE 0 END"


def _rank_sql(queries: list[str], ordinal: str, name: str, full: str, frame: str) -> str:
    """The SQL of rank() over a table."""
    return f"""WITH q AS (SELECT unnest([{", ".join(f"'{q}'" for q in queries)}]) AS query),
i AS (SELECT {ordinal} AS ordinal, {_ASCII.format(name)} AS name, {_ASCII.format(full)} AS "full" FROM {frame}),
t AS (SELECT query, unnest(string_split(query, ' ')) AS t FROM q WHERE query <> ''),
s AS (SELECT query, ordinal, name, {_TERM} AS s FROM t, i),
r AS (SELECT query, ordinal, round(sum(s) - length(any_value(name)) / 1000.0, 6) AS score FROM s GROUP BY query, ordinal HAVING min(s) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal) AS place FROM r)
SELECT query, ordinal, CAST(score AS DOUBLE) AS score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 8"""


_ASKED = f"s AS (SELECT unnest(range({len(SEARCHES)})) AS query_id, unnest([{', '.join(repr(q) for q in SEARCHES)}]) AS query)"
_FOUND = f"""{rooms.answered("SELECT query FROM s", TOP - 2, _ASKED)},
i AS (SELECT building_id AS ordinal, name AS entry, {_ASCII.format("name")} AS name, {_ASCII.format("name || ' ' || coalesce(official_name, '')")} AS "full", coalesce(len(parts), 0) AS inside FROM directory),
ib AS (SELECT *, CASE WHEN inside > 0 THEN 20.0 * least(1.0, ln(1.0 + inside) / ln(13.0)) / (least(1.0, ln(1.0 + inside) / ln(13.0)) + 3.0) ELSE 0.0 END AS bonus FROM i),
tm AS (SELECT query_id, unnest(string_split({_ASCII.format("query")}, ' ')) AS t FROM s WHERE {_ASCII.format("query")} <> ''),
sc AS (SELECT query_id, ordinal, entry, name, bonus, {_TERM} AS s FROM tm, ib),
rk AS (SELECT query_id, ordinal, any_value(entry) AS entry, round(sum(s) + any_value(bonus) - length(any_value(name)) / 1000.0, 6) AS score FROM sc GROUP BY query_id, ordinal HAVING min(s) > 0),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS seat FROM rk),
un AS (SELECT s.query_id, 0 AS section, position AS seat, name || ', ' || place AS entry, CAST(NULL AS DOUBLE) AS score FROM found JOIN s ON s.query = found.query
  UNION ALL SELECT query_id, 1, seat, entry, CAST(score AS DOUBLE) FROM pl WHERE seat <= 8),
fo AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY section, seat) AS INTEGER) AS position, section, entry, score FROM un),
fi AS (SELECT fo.* FROM fo JOIN s USING (query_id) WHERE position <= 8 OR {_ASCII.format("query")} = '')"""
_HERE = f"wh AS (SELECT query_id FROM s WHERE {_ASCII.format('query')} = '' OR contains('{HERE_PHRASE}', {_ASCII.format('query')}) OR starts_with({_ASCII.format('query')}, 'you'))"

_WEIGHTS = """WITH e AS (SELECT user_id, ts FROM events WHERE event_type IN ('view', 'purchase')), n AS (SELECT max(ts) AS now FROM e),
w AS (SELECT user_id, sum(pow(0.5, (epoch_us(now) - epoch_us(ts)) / 86400000000.0 / 21.0)) AS weight FROM e, n GROUP BY user_id)"""

ORACLES = {
    "name_rank_top8": f"""WITH q AS (SELECT unnest([{", ".join(f"'{q}'" for q in NAME_QUERIES)}]) AS query),
i AS (SELECT building_id AS ordinal, {_ASCII.format("name")} AS name, {_ASCII.format("name || ' ' || coalesce(official_name, '')")} AS "full" FROM directory),
t AS (SELECT query, unnest(string_split(query, ' ')) AS t FROM q WHERE query <> ''),
s AS (SELECT query, ordinal, name, {_TERM} AS s FROM t, i),
r AS (SELECT query, ordinal, round(sum(s) - length(any_value(name)) / 1000.0, 6) AS score FROM s GROUP BY query, ordinal HAVING min(s) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal) AS place FROM r)
SELECT query, ordinal, CAST(score AS DOUBLE) AS score, CAST(place AS INTEGER) AS place FROM p WHERE place <= 8""",
    "part_rank_top8": _rank_sql(PART_QUERIES, "p_partkey", "p_name", "concat_ws(' ', p_name, p_type)", "part"),
    "doc_rank_top8": _rank_sql(DOC_QUERIES, "doc_id", "split_part(text, chr(10), 1)", "text", "documents"),
    "popular_decay": f"{_WEIGHTS} SELECT user_id, round(weight, 6) AS weight FROM w",
    "popular_bonus": f"{_WEIGHTS} SELECT user_id, round(20.0 * weight / (weight + 3.0), 6) AS bonus FROM w",
    "popular_shelf": f"""{_WEIGHTS}, a AS (SELECT 0 AS shelf, user_id, round(weight, 6) AS w FROM w ORDER BY w DESC, user_id LIMIT 12), b AS (SELECT 1 AS shelf, user_id, round(max(value), 6) AS w FROM events GROUP BY user_id ORDER BY w DESC, user_id LIMIT 12),
u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY shelf) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT user_id, shelf, w FROM u WHERE rn = 1 ORDER BY shelf, w DESC, user_id LIMIT 6""",
    "search_top8": f"{_FOUND} SELECT query_id, position, section, entry, score FROM fi",
    "search_suggestions": f"""{_FOUND}, {_HERE},
al AS (SELECT fi.query_id, position, section, entry, score FROM fi UNION ALL SELECT query_id, 0, -1, '{HERE}', NULL FROM wh)
SELECT query_id, position, section, entry, score FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY section, position) AS INTEGER) AS position, section, entry, score FROM al)
WHERE position <= 8 OR query_id NOT IN (SELECT query_id FROM wh)""",
    "prominent_names": "SELECT name, round(least(1.0, ln(1.0 + len(parts)) / ln(13.0)), 9) AS weight FROM directory WHERE len(parts) > 0",
    "popular_entries": """WITH n AS (SELECT text AS name, 0 AS shelf, CAST(count(*) AS DOUBLE) AS w FROM labels WHERE text IS NOT NULL GROUP BY text
  UNION ALL SELECT name, 1, round(least(1.0, ln(1.0 + len(parts)) / ln(13.0)), 9) FROM directory WHERE len(parts) > 0),
o AS (SELECT name, shelf, w FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY shelf, w DESC) AS rn FROM n) WHERE rn = 1)
SELECT name, shelf, w FROM o WHERE name IN (SELECT name FROM directory) ORDER BY shelf, w DESC, name LIMIT 6""",
}
