import math

import pytest
from pyspark.sql import functions as F

from quadrant.functions import geo, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_and_labels(spark):
    rows = spark.createDataFrame([(f,) for f in (0.0, 12.0, 48.0, 123.0, 487.0, 512.0, 5280.0, -3.0)], "f double")
    assert [r[0] for r in rows.select(units.nice_feet(F.col("f"))).collect()] == ["0 ft", "10 ft", "50 ft", "120 ft", "490 ft", "500 ft", "1.0 mi", "0 ft"]
    assert one(spark, units.half_up(F.lit(-2.5))) == -2
    assert one(spark, units.walk_label(F.lit(10.0))) == "1 min"
    assert one(spark, units.walk_label(F.lit(84.0 * 61))) == "1 hr 1 min"


@pytest.mark.parametrize(("degrees", "kind"), [(0, "straight"), (19.9, "straight"), (20, "slight-right"), (-45, "slight-left"), (60, "slight-right"), (60.5, "right"), (-90, "left"), (150, "right"), (179, "uturn")])
def test_turns(spark, degrees, kind):
    assert one(spark, units.turn_kind(F.lit(float(degrees)))) == kind


def test_bonus_ignores_what_is_no_weight(spark):
    assert one(spark, units.bonus_for(F.lit(float("nan")))) == 0
    assert one(spark, units.bonus_for(F.lit(-1.0))) == 0
    assert one(spark, units.bonus_for(F.lit(3.0))) == 10


def test_folding(spark):
    assert one(spark, text.folded_key(F.lit("Café Résumé"))) == "cafe re sume"
    assert one(spark, text.folded_key(F.lit(None).cast("string"))) == ""
    assert one(spark, text.shortened(F.lit("a" * 100), 5)) == "aaaaa…"


def test_coordinates(spark):
    for raw, want in (("1,2", (1.0, 2.0)), ("1,", (1.0, 0.0)), ("181,2", None), ("1,2,3", None), ("x,2", None), ("NaN,2", None)):
        got = one(spark, geo.parse_coordinate(F.lit(raw)))
        assert (tuple(got) if got else None) == want


def test_rings(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))])
    hole = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))])
    assert one(spark, geo.ring_area(square)) == 4
    assert one(spark, geo.polygon_area(F.array(square, hole))) == 3
    assert tuple(one(spark, geo.ring_centroid(square))) == (1.0, 1.0)
    assert one(spark, geo.in_polygon(F.lit(0.2), F.lit(0.2), F.array(square, hole)))
    assert not one(spark, geo.in_polygon(F.lit(1.0), F.lit(1.0), F.array(square, hole)))
    assert not one(spark, geo.in_polygon(F.lit(3.0), F.lit(1.0), F.array(square)))


def test_segments(spark):
    n = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geo.to_segment(*n(0, 1, 0, 0, 0, 0))) == 1
    assert one(spark, geo.to_segment(*n(5, 1, 0, 0, 2, 0))) == pytest.approx(math.hypot(3, 1))
    assert tuple(one(spark, geo.crossing(*n(0, 0, 2, 2, 0, 2, 2, 0)))) == (0.5, 0.5)
    assert one(spark, geo.crossing(*n(0, 0, 1, 0, 0, 1, 1, 1))) is None


def test_interpolation(spark):
    linear = units.stops(F.lit(7.0), [(5, 1.0), (9, 3.0)])
    assert one(spark, linear) == 2
    assert one(spark, units.stops(F.lit(1.0), [(5, 1.0), (9, 3.0)])) == 1
    assert one(spark, units.stops(F.lit(99.0), [(5, 1.0), (9, 3.0)])) == 3
    assert one(spark, units.stops(F.lit(6.0), [(5, 0.0), (7, 3.0)], 2.0)) == 1
