"""Geometry as column expressions: distances, bearings, rings, segments and clipping. All stay inside codegen."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
FEET_PER_METRE = 3280.84 / 1000


def dbl(value: float | str | Column) -> Column:
    """A column, a column name, or a number as DOUBLE."""
    column = value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(float(value))
    return column.cast("double")


def key_position(key: Column) -> tuple[Column, Column]:
    """(lon, lat) that integer keys are given where a table has no geometry; exact integer arithmetic, one division."""
    lon = F.lit(-121.36) + ((key * 7919) % 10007).cast("double") / F.lit(10007.0) * F.lit(0.02)
    lat = F.lit(38.635) + ((key * 104729) % 9973).cast("double") / F.lit(9973.0) * F.lit(0.02)
    return lon, lat


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine metres on the mean sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


@dataclass(frozen=True)
class FlatModel:
    """Metres per degree of latitude and longitude; ``follow_latitude`` scales the latter by the first point's latitude."""

    lat_m: float
    lon_m: float
    follow_latitude: bool = False

    def metres(self, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
        across = F.lit(self.lat_m) * F.cos(F.radians(lat1)) if self.follow_latitude else F.lit(self.lon_m)
        return F.hypot((lon2 - lon1) * across, (lat2 - lat1) * F.lit(self.lat_m))

    def flat(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Metres east and north of the origin of degrees."""
        return lon * self.lon_m, lat * self.lat_m

    def unflat(self, x: Column, y: Column, places: int = 7) -> tuple[Column, Column]:
        """Degrees of flat metres, rounded."""
        return F.round(x / self.lon_m, places), F.round(y / self.lat_m, places)


_RAD = math.pi / 180
#: The flat models in use; results differ in the third digit, so each operator names its own.
FLAT_MODELS = {
    "D2": FlatModel(EARTH_M * _RAD, EARTH_M * _RAD * math.cos(38.6493 * _RAD)),
    "D3": FlatModel(111320.0, 111320.0 * math.cos(38.6547 * _RAD)),
    "D4": FlatModel(111320.0, 0.0, follow_latitude=True),
    "D5": FlatModel(111320.0, 87000.0),
    "D6": FlatModel(110980.0, 86940.0),
    "D7": FlatModel(111132.0, 86900.0),
}


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial great-circle bearing in (-180, 180]."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.degrees(F.atan2(y, x))


def turn_deg(incoming: Column, outgoing: Column) -> Column:
    """Change of bearing wrapped to [-180, 180]."""
    raw = outgoing - incoming
    return F.when(raw > 180, raw - 360).when(raw < -180, raw + 360).otherwise(raw)


def undirected_gap(a: Column, b: Column) -> Column:
    """Angle between two undirected bearings, 0 to 90."""
    gap = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(gap, F.lit(180.0) - gap)


def affine(x: Column, y: Column, a: float, b: float, c: float, d: float, e: float, f: float, places: int = 7) -> tuple[Column, Column]:
    """(a + b x + c y, d + e x + f y) rounded: drawing units to degrees."""
    return F.round(F.lit(a) + x * b + y * c, places), F.round(F.lit(d) + x * e + y * f, places)


def affine_inverse(lon: Column, lat: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """Drawing units of degrees: what affine() of the same numbers maps there, before rounding."""
    det = b * f - c * e
    return ((lon - a) * f - (lat - d) * c) / det, ((lat - d) * b - (lon - a) * e) / det


def grown_box(extent: Column, margin_m: float) -> Column:
    """STRUCT<west, south, east, north> of an extent (lon, lat, half_width, half_height in metres of model D7) with a margin on every side."""
    model = FLAT_MODELS["D7"]
    dx, dy = (extent["half_width"] + margin_m) / model.lon_m, (extent["half_height"] + margin_m) / model.lat_m
    return F.struct((extent["lon"] - dx).alias("west"), (extent["lat"] - dy).alias("south"), (extent["lon"] + dx).alias("east"), (extent["lat"] + dy).alias("north"))


def parse_coordinate(text: Column) -> Column:
    """STRUCT<lon, lat> of 'lon,lat', null unless both are finite and in range. An empty part counts as 0, as a blank number does in the source form."""
    parts = F.split(text, ",", -1)
    number = lambda i: F.when(F.trim(F.get(parts, F.lit(i))) == "", F.lit(0.0)).otherwise(F.get(parts, F.lit(i)).try_cast("double"))
    lon, lat = number(0), number(1)
    good = (F.size(parts) == 2) & ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.when(good, F.struct(lon.alias("lon"), lat.alias("lat")))


# Rings are ARRAY<STRUCT<lon, lat>>, closed or not.


def _edges(ring: Column) -> Column:
    """ARRAY<STRUCT<a, b>> of a ring's edges, the closing one included."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, F.when(i + 1 < F.size(ring), i + 2).otherwise(F.lit(1)).cast("int")).alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area in squared degrees, counted from the first vertex to keep digits; counter-clockwise is positive."""
    x0, y0 = ring[0]["lon"], ring[0]["lat"]
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + ((e["a"]["lon"] - x0) * (e["b"]["lat"] - y0) - (e["b"]["lon"] - x0) * (e["a"]["lat"] - y0))) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less the others'."""
    areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas), F.lit(1))), F.element_at(areas, 1), lambda s, x: s - x)


def ring_centroid(ring: Column) -> Column:
    """Area centroid STRUCT<lon, lat>; the first vertex where the area vanishes. Coordinates are taken from the first vertex, to keep digits."""
    x0, y0 = ring[0]["lon"], ring[0]["lat"]
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"] - x0, e["a"]["lat"] - y0, e["b"]["lon"] - x0, e["b"]["lat"] - y0
        k = ax * by - bx * ay
        return F.struct((s["s"] + k).alias("s"), (s["x"] + (ax + bx) * k).alias("x"), (s["y"] + (ay + by) * k).alias("y"))

    total = F.aggregate(_edges(ring), zero, add)
    flat = F.abs(total["s"]) < 1e-18
    return F.struct(F.when(flat, x0).otherwise(x0 + total["x"] / (3 * total["s"])).alias("lon"), F.when(flat, y0).otherwise(y0 + total["y"] / (3 * total["s"])).alias("lat"))


def ring_box(ring: Column) -> Column:
    """STRUCT<west, south, east, north>."""
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test, half open in latitude."""

    def cross(odd: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        hit = ((lat < a["lat"]) != (lat < b["lat"])) & (lon < a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"]))
        return odd != F.coalesce(hit, F.lit(False))

    return F.aggregate(_edges(ring), F.lit(False), cross)


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    """In the first ring and in none of the others."""
    return in_ring(lon, lat, rings[0]) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda hole: in_ring(lon, lat, hole))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Flat distance from a point to a segment; a segment without length is its point."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """STRUCT<t, u> where segments ab and cd meet, ends included; null if they are parallel or do not meet."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    safe = F.when(F.abs(den) >= 1e-12, den)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / safe
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / safe
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct(t.alias("t"), u.alias("u")))


def clip_to_box(x1: Column, y1: Column, x2: Column, y2: Column, west: float, south: float, east: float, north: float) -> tuple[Column, Column]:
    """(t0, t1) of the part of a segment inside a box, null where there is none: each side narrows the span."""
    dx, dy = x2 - x1, y2 - y1
    low, high, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for p, q in ((-dx, x1 - west), (dx, F.lit(east) - x1), (-dy, y1 - south), (dy, F.lit(north) - y1)):
        ratio = q / F.nullif(p, F.lit(0.0))
        low.append(F.when(p < 0, ratio).otherwise(F.lit(0.0)))
        high.append(F.when(p > 0, ratio).otherwise(F.lit(1.0)))
        outside = outside | ((p == 0) & (q < 0))
    t0, t1 = F.greatest(*low), F.least(*high)
    kept = ~outside & (t0 <= t1)
    return F.when(kept, t0), F.when(kept, t1)
