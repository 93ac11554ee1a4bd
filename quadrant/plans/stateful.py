"""Queries over ordered events: limits, freshness, buffers and latest-wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrant.functions.phrases import nav_eta
from quadrant.operators import ordered
from quadrant.plans.paths import STEPS
from quadrant.sources.tables import table

HALF_DAY_MS = 12 * 3600 * 1000


def _events(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    rows = table(spark, folder, "events", "event_id", "user_id", "ts", *more)
    return rows.withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    """One event per user and window of half a day that opens at the first."""
    return ordered.rate_limit(_events(spark, folder), "user_id", "at", "event_id", HALF_DAY_MS, 1)


def flushes(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of each user given out in batches, at the earliest a day after the last."""
    found = ordered.tumbling_flush(_events(spark, folder, "value"), "user_id", "at", "event_id", "value", 2 * HALF_DAY_MS)
    return found.select("user_id", "at", "samples", F.round("mean", 6).alias("mean"), "upper_median", "most")


def latched(spark: SparkSession, folder: str) -> DataFrame:
    """What a status line would show after each event."""
    action = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "busy").otherwise("rest")
    return ordered.latched_status(_events(spark, folder, "event_type").withColumn("action", action), "user_id", "at", "event_id", "action")


def latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and type."""
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    return rows.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("l")).select("user_id", "event_type", F.col("l.event_id").alias("event_id"))


def asof_fresh(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase, the user's last view before it, if it is younger than twelve hours: an as-of join by one window, no pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    view = F.when(F.col("event_type") == "view", F.struct("event_id", "ts"))
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").withColumn("v", F.last(view, ignorenulls=True).over(w)).filter("event_type = 'purchase'")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("v.ts").cast("timestamp"))) / 1_000_000
    return rows.select("event_id", F.when(age < 43200, F.col("v.event_id")).alias("view_id"))


def rolling_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and longest of each user's last 24 gaps between events, in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1_000_000
    rows = table(spark, folder, "events", "event_id", "user_id", "ts").withColumn("gap", gap)
    last = w.rowsBetween(-23, 0)
    return rows.select("event_id", F.round(F.avg("gap").over(last), 3).alias("mean_gap"), F.max("gap").over(last).alias("longest"))


def calm_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a user's last four gaps are calm: upper median below a day, none above three; false until there are four."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1_000_000
    rows = table(spark, folder, "events", "event_id", "user_id", "ts").withColumn("gap", gap)
    held = rows.select("event_id", F.sort_array(F.collect_list("gap").over(w.rowsBetween(-3, 0))).alias("g"))
    calm = (F.size("g") == 4) & (F.get("g", F.lit(2)) < 86400) & (F.get("g", F.lit(3)) < 3 * 86400)
    return held.select("event_id", F.coalesce(calm, F.lit(False)).alias("calm"))


def change_points(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose type differs from the user's one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type").withColumn("was", F.lag("event_type").over(w))
    return rows.filter(~F.col("event_type").eqNullSafe(F.col("was"))).select("event_id", "was", F.col("event_type").alias("now"))


def capped_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's decayed visits of kinds of events when only the three heaviest are kept; the weight after every event."""
    found = ordered.capped_visits(_events(spark, folder, "event_type").filter("event_type is not null"), "user_id", "at", "event_id", "event_type", 21 * 2 * HALF_DAY_MS, 3)
    return found.select("event_id", "name", F.round("weight", 6).alias("weight"))


def kept_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that users' events reuse while they have more than an hour to live; they live for hours given by the event, purchases fail."""
    hours = F.when(F.col("event_type") != "purchase", (F.pmod("event_id", F.lit(40)) + 2) * 3_600_000)
    return ordered.reused_until(_events(spark, folder, "event_type").withColumn("life", hours), "user_id", "at", "event_id", "life", 3_600_000)


def fix_or_error(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase, taken as asking for a position: the last view if younger than twelve hours, else the next within six, else the last of any age, else error 3."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    view = F.when(F.col("event_type") == "view", F.struct("event_id", "ts"))
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").filter("user_id is not null and ts is not null")
    rows = rows.withColumn("before", F.last(view, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(view, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = F.coalesce(micros("ts") - micros("before.ts") < 43_200_000_000, F.lit(False))
    soon = F.coalesce(micros("after.ts") - micros("ts") <= 21_600_000_000, F.lit(False))
    chosen = F.when(fresh, F.col("before.event_id")).when(soon, F.col("after.event_id")).otherwise(F.col("before.event_id"))
    return rows.filter("event_type = 'purchase'").select("event_id", chosen.alias("view_id"), F.when(fresh, "fresh").when(soon, "waited").when(F.col("before").isNotNull(), "stale").otherwise("error 3").alias("how"))


def held_presses(spark: SparkSession, folder: str) -> DataFrame:
    """Views, taken as presses, that nothing of the same user ends within six hours: a later press, a purchase or an error; each how long until then."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").filter("user_id is not null and ts is not null and event_type in ('view', 'purchase', 'error')")
    gap = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    return rows.withColumn("gap", gap).filter("event_type = 'view'").select("event_id", F.coalesce(F.col("gap") >= 21600, F.lit(True)).alias("held"), "gap")


def banner(spark: SparkSession, folder: str) -> DataFrame:
    """What a walker's banner shows at each event: step, feet to it and to the end, arrival, time left, and whether the card is the first, swapped, or the same."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    end = STEPS[-1]
    rows = table(spark, folder, "events", "event_id", "user_id", "ts", "value").filter("value is not null and user_id is not null and ts is not null").withColumn("along", F.round(F.abs("value") * 10 % end, 6))
    here = F.least(F.lit(len(STEPS) - 1), F.size(F.filter(F.array(*map(F.lit, STEPS)), lambda k: k < F.col("along") + 25)))
    rows = rows.withColumn("here", here).withColumn("step", F.max("here").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    to_step = F.greatest(F.lit(0.0), F.element_at(F.array(*map(F.lit, STEPS)), (F.col("step") + 1).cast("int")) - F.col("along"))
    left = F.greatest(F.lit(0.0), F.lit(end) - F.col("along"))
    was = F.lag("step").over(w)
    card = F.when(was.isNull(), "first").when(was != F.col("step"), "swap").otherwise("same")
    return rows.select("event_id", F.col("step").cast("long").alias("step"), F.round(to_step, 4).alias("to_step"), (left <= 25).alias("arrived"), nav_eta(left * 60).alias("eta"), card.alias("card"))


QUERIES = {f.__name__: f for f in (capped_visits, kept_sessions, fix_or_error, held_presses, banner, rate_limit, flushes, latched, latest_wins, asof_fresh, rolling_gaps, calm_flag, change_points)}

_GAPS = "WITH g AS (SELECT event_id, user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS gap FROM events)"
_IN_ORDER = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
ORACLES = {
    "flushes": f"""WITH RECURSIVE {_IN_ORDER},
r AS (SELECT user_id, rn, ms, ms AS since, CASE WHEN value IS NULL THEN CAST([] AS DOUBLE[]) ELSE [CAST(value AS DOUBLE)] END AS held, CAST([] AS DOUBLE[]) AS given FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.ms, CASE WHEN f THEN e.ms ELSE since END, CASE WHEN f THEN CAST([] AS DOUBLE[]) ELSE h END, CASE WHEN f THEN h ELSE CAST([] AS DOUBLE[]) END
  FROM (SELECT e.user_id, e.rn, e.ms, r.since, CASE WHEN e.value IS NULL THEN r.held ELSE list_append(r.held, CAST(e.value AS DOUBLE)) END AS h, e.ms - r.since >= 86400000 AND len(r.held) + CASE WHEN e.value IS NULL THEN 0 ELSE 1 END >= 2 AS f FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) e)
SELECT user_id, ms AS at, CAST(len(given) AS BIGINT) AS samples, round(list_avg(given), 6) AS mean, list_sort(given)[len(given) // 2 + 1] AS upper_median, list_max(given) AS most FROM r WHERE len(given) > 0""",
    "latched": f"""WITH RECURSIVE {_IN_ORDER}, a AS (SELECT user_id, rn, event_id, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'error' WHEN 'view' THEN 'busy' ELSE 'rest' END AS act FROM e),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 'rest' AS shown, CAST(0 AS BIGINT) AS depth, false AS latched FROM a WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN act IN ('error', 'set') THEN act WHEN latched THEN shown WHEN d > 0 THEN 'busy' ELSE 'rest' END, d, CASE act WHEN 'error' THEN true WHEN 'set' THEN false ELSE latched END
  FROM (SELECT a.user_id, a.rn, a.event_id, a.act, r.shown, r.latched, CASE a.act WHEN 'busy' THEN r.depth + 1 WHEN 'rest' THEN greatest(0, r.depth - 1) ELSE r.depth END AS d FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1))
SELECT event_id, shown, depth FROM r WHERE rn > 0""",
    "kept_sessions": f"""WITH RECURSIVE {_IN_ORDER}, a AS (SELECT user_id, rn, event_id, ms, CASE WHEN event_type <> 'purchase' THEN (event_id % 40 + 2) * 3600000 END AS life FROM e),
r AS (SELECT user_id, rn, event_id, true AS minted, ms + life AS expires FROM a WHERE rn = 1
  UNION ALL SELECT a.user_id, a.rn, a.event_id, coalesce(r.expires <= a.ms + 3600000, true), CASE WHEN coalesce(r.expires <= a.ms + 3600000, true) THEN a.ms + a.life ELSE r.expires END FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT event_id, minted, expires FROM r""",
    "fix_or_error": """WITH v AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN {'e': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN event_type = 'view' THEN {'e': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(b.t) < 43200000000, false) AS fresh, coalesce(epoch_us(n.t) - epoch_us(ts) <= 21600000000, false) AS soon FROM v WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN fresh THEN b.e WHEN soon THEN n.e ELSE b.e END AS view_id, CASE WHEN fresh THEN 'fresh' WHEN soon THEN 'waited' WHEN b.e IS NOT NULL THEN 'stale' ELSE 'error 3' END AS how FROM c""",
    "held_presses": """WITH g AS (SELECT event_id, event_type, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1000000.0 AS gap FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IN ('view', 'purchase', 'error'))
SELECT event_id, coalesce(gap >= 21600, true) AS held, gap FROM g WHERE event_type = 'view'""",
    "banner": """WITH a AS (SELECT event_id, user_id, ts, round(fmod(abs(value) * 10, 700), 6) AS along FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
h AS (SELECT *, least(5, len(list_filter([0.0, 100.0, 260.0, 300.0, 420.0, 700.0], lambda k: k < along + 25))) AS here FROM a),
s AS (SELECT *, max(here) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step FROM h), l AS (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, greatest(0.0, 700 - along) AS feet FROM s)
SELECT event_id, CAST(step AS BIGINT) AS step, CAST(round(greatest(0.0, [0.0, 100.0, 260.0, 300.0, 420.0, 700.0][step + 1] - along), 4) AS DOUBLE) AS to_step, feet <= 25 AS arrived,
CASE WHEN feet / 4.6 < 1 THEN '< 1 min' ELSE CAST(CAST(floor(feet * 60 / 4.6 / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' min' END AS eta, CASE WHEN was IS NULL THEN 'first' WHEN was <> step THEN 'swap' ELSE 'same' END AS card FROM l""",
    "rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, rn, event_id, ms, ms + 43200000 AS ends, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.event_id, e.ms, CASE WHEN r.ends <= e.ms THEN e.ms + 43200000 ELSE r.ends END, CASE WHEN r.ends <= e.ms THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, n <= 1 AS allowed, CAST(greatest(0, 1 - n) AS BIGINT) AS remaining, CAST(greatest(1, ceil((ends - ms) / 1000.0)) AS BIGINT) AS retry_after FROM r""",
    "latest_wins": "SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY 1, 2",
    "asof_fresh": """WITH v AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN {'e': event_id, 't': ts} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM events)
SELECT event_id, CASE WHEN (epoch_us(ts) - epoch_us(v.t)) / 1000000.0 < 43200 THEN v.e END AS view_id FROM v WHERE event_type = 'purchase'""",
    "rolling_gaps": f"{_GAPS} SELECT event_id, round(avg(gap) OVER w, 3) AS mean_gap, max(gap) OVER w AS longest FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
    "calm_flag": f"""{_GAPS}, l AS (SELECT event_id, list_sort(list_filter(list(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS g FROM g)
SELECT event_id, coalesce(len(g) = 4 AND g[3] < 86400 AND g[4] < 259200, false) AS calm FROM l""",
    "change_points": """WITH w AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT event_id, was, event_type AS now FROM w WHERE event_type IS DISTINCT FROM was""",
}
