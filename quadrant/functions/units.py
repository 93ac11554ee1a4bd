"""Lengths, durations, turns and map scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column) -> Column:
    """Nearest whole number, halves upwards (-2.5 gives -2)."""
    return F.floor(value + 0.5)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, halves upwards."""
    tenths = half_up(value * 10)
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("long").cast("string"))


def nice_feet(feet: Column) -> Column:
    """Walking distance as a person would say it: steps of 5, 10 or 50 feet, miles from 5280 on."""
    step = F.when(feet < 50, 5).when(feet < 500, 10).otherwise(50)
    rounded = F.greatest(half_up(feet / step) * step, F.lit(0)).cast("long")
    return F.when(feet >= 5280, F.concat(one_decimal(feet / 5280), F.lit(" mi"))).otherwise(F.concat(rounded.cast("string"), F.lit(" ft")))


def walk_label(metres: Column, metres_per_second: float = 1.4) -> Column:
    """Minutes rounded up, one at least; hours from 60 minutes on."""
    minutes = F.greatest(F.ceil(metres / (metres_per_second * 60)), F.lit(1)).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    left = minutes - hours * 60
    long = F.concat(hours.cast("string"), F.lit(" hr"), F.when(left > 0, F.concat(F.lit(" "), left.cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).otherwise(long)


def turn_kind(degrees: Column) -> Column:
    """straight, slight, turn or u-turn with its side, by the change of bearing; 20 is slight, 60 still slight, 150 still a turn."""
    size = F.abs(degrees)
    side = F.when(degrees > 0, "right").otherwise("left")
    return F.when(size < 20, "straight").when(size > 150, "uturn").when(size <= 60, F.concat(F.lit("slight-"), side)).otherwise(side)


def bonus_for(weight: Column, most: float = 20.0, midpoint: float = 3.0) -> Column:
    """A saturating bonus below ``most``; nothing for weights that are not positive numbers."""
    return F.when((weight > 0) & ~F.isnan(weight), most * weight / (weight + midpoint)).otherwise(0.0)


def stops(value: Column, points: list[tuple[float, float]], base: float = 1.0) -> Column:
    """Piecewise interpolation between (input, output) points, clamped outside; ``base`` other than 1 bends it exponentially."""
    result = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        share = (value - x0) / (x1 - x0) if base == 1.0 else (F.pow(F.lit(base), value - x0) - 1) / (base ** (x1 - x0) - 1)
        result = F.when(value < x1, F.lit(float(y0)) + share * (y1 - y0)).otherwise(result)
    return F.when(value <= points[0][0], F.lit(float(points[0][1]))).otherwise(result)


def zoom_for_span(width_px: Column, lat: Column, span_m: Column) -> Column:
    """Web-map zoom at which a span of metres fills a width of pixels."""
    return F.log2(width_px * 156543.03392 * F.cos(F.radians(lat)) / span_m)
