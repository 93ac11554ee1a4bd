"""The sun's place in the sky from UTC time and position, as column expressions (published solar-position series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HORIZON_DEG, CIVIL_DEG = -0.833, 6.0


def _sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def sun_elevation(ts: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """(elevation, hour angle) in degrees at a UTC timestamp."""
    return sun_place(ts, lon, lat)[:2]


def sun_place(ts: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(elevation, hour angle, declination) in degrees at a UTC timestamp."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("double")
    century = (micros / 86_400_000_000.0 + 2_440_587.5 - 2_451_545.0) / 36_525.0
    # Coefficients of the series.
    mean_longitude = (280.46646 + century * (36_000.76983 + century * 0.0003032)) % 360
    anomaly = 357.52911 + century * (35_999.05029 - century * 0.0001537)
    centre = _sin(anomaly) * (1.914602 - century * (0.004817 + 0.000014 * century)) + _sin(anomaly * 2) * (0.019993 - 0.000101 * century) + _sin(anomaly * 3) * 0.000289
    node = 125.04 - 1934.136 * century
    longitude = mean_longitude + centre - 0.00569 - _sin(node) * 0.00478
    tilt = 23 + (26 + (21.448 - century * (46.815 + century * (0.00059 - century * 0.001813))) / 60) / 60 + F.cos(F.radians(node)) * 0.00256
    declination = F.asin(_sin(tilt) * _sin(longitude))
    y = F.pow(F.tan(F.radians(tilt / 2)), 2)
    e = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    equation = (4 * 180 / math.pi) * (
        y * _sin(mean_longitude * 2) - e * 2 * _sin(anomaly) + e * 4 * y * _sin(anomaly) * F.cos(F.radians(mean_longitude * 2)) - y * y * 0.5 * _sin(mean_longitude * 4) - e * e * 1.25 * _sin(anomaly * 2)
    )
    minute = (F.pmod(micros, F.lit(86_400_000_000.0))) / 60_000_000.0
    hour_angle = ((minute + equation + lon * 4 + 1440) % 1440) / 4 - 180
    elevation = F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(F.radians(hour_angle))))
    return elevation, hour_angle, F.degrees(declination)


def light_preset(elevation: Column, hour_angle: Column) -> Column:
    """day above civil twilight, dawn or dusk down to the horizon, else night."""
    return F.when(elevation > CIVIL_DEG, "day").when(elevation > HORIZON_DEG, F.when(hour_angle < 0, "dawn").otherwise("dusk")).otherwise("night")


def next_check_ms(elevation: Column) -> Column:
    """Milliseconds until the preset could change at the earliest, between one and fifteen minutes."""
    gap = F.least(F.abs(elevation - HORIZON_DEG), F.abs(elevation - CIVIL_DEG))
    return F.greatest(F.lit(60_000.0), F.least(F.lit(900_000.0), gap / 0.196 * 60_000))
