from quadrant.operators import ordered

SCHEMA = "user long, at long, id long, value double, act string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_rate_limit_opens_at_the_first_event(spark):
    rows = [(1, t, i, None, None) for i, t in enumerate((0, 10, 500, 999, 1000, 1001, 5000))] + [(None, 1, 90, None, None), (2, None, 91, None, None), (2, 5, 92, None, None)]
    got = {r["id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in ordered.rate_limit(frame(spark, rows), "user", "at", "id", 1000, 3).collect()}
    assert got == {0: (True, 2, 1), 1: (True, 1, 1), 2: (True, 0, 1), 3: (False, 0, 1), 4: (True, 2, 1), 5: (True, 1, 1), 6: (True, 2, 1), 92: (True, 2, 1)}


def test_flush_is_anchored_at_the_last_emission(spark):
    rows = [(1, t, i, v, None) for i, (t, v) in enumerate(((0, 1.0), (100, 2.0), (260, 3.0), (300, 4.0), (520, 5.0), (530, None)))]
    got = [tuple(r) for r in ordered.tumbling_flush(frame(spark, rows), "user", "at", "id", "value", 250).collect()]
    assert got == [(1, 260, 3, 2.0, 2.0, 3.0), (1, 520, 2, 4.5, 5.0, 5.0)]


def test_latch(spark):
    rows = [(1, i, i, None, a) for i, a in enumerate(("rest", "busy", "busy", "error", "rest", "rest", "busy", "set", "rest"))]
    got = {r["id"]: (r["shown"], r["depth"]) for r in ordered.latched_status(frame(spark, rows), "user", "at", "id", "act").collect()}
    assert [got[i] for i in range(9)] == [("rest", 0), ("busy", 1), ("busy", 2), ("error", 2), ("error", 1), ("error", 0), ("error", 1), ("set", 1), ("rest", 0)]


def test_capped_visits_forget_the_lightest(spark):
    rows = [(1, t, t, None, n) for t, n in ((0, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "a"))]
    got = {r["id"]: (r["name"], round(r["weight"], 6)) for r in ordered.capped_visits(frame(spark, rows), "user", "at", "id", "act", 1e12, 2).collect()}
    assert got == {0: ("a", 1.0), 1: ("b", 1.0), 2: ("b", 2.0), 3: ("c", 1.0), 4: ("a", 1.0)}


def test_empty(spark):
    assert ordered.rate_limit(frame(spark, []), "user", "at", "id", 1000, 3).count() == 0


def test_kept_things_are_made_anew_when_little_time_is_left(spark):
    rows = [(1, t, i, life, None) for i, (t, life) in enumerate(((0, 100.0), (50, 9.0), (80, 500.0), (90, 1.0), (600, None), (610, 50.0)))]
    frame_ = frame(spark, rows).selectExpr("user", "at", "id", "cast(value as long) as life")
    got = {r["id"]: (r["minted"], r["expires"]) for r in ordered.reused_until(frame_, "user", "at", "id", "life", 20).collect()}
    assert got == {0: (True, 100), 1: (False, 100), 2: (True, 580), 3: (False, 580), 4: (True, None), 5: (True, 660)}
