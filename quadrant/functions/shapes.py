"""Polygon and line geometry as column expressions. Rings are ARRAY<STRUCT<lon, lat>> with the first point repeated at the end; lines likewise, not closed.

A polygon is an array of rings, its first ring the outline. Lengths use a flat model (functions.geo.FLAT_MODELS) named by each function. Null and empty
rings give null, unless said otherwise.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quadrant.functions import geo
from quadrant.functions.geo import FLAT_MODELS, FlatModel

INFINITE = float("inf")
D3, D7 = FLAT_MODELS["D3"], FLAT_MODELS["D7"]


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def pairs(line: Column) -> Column:
    """ARRAY<STRUCT<a, b>> of consecutive points."""
    n = F.size(line)
    return F.when(n > 1, F.transform(F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda b, i: F.struct(F.get(line, i).alias("a"), b.alias("b"))))


def corners_of(ring: Column) -> Column:
    """The ring without its closing point."""
    return F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))


def vertex_mean(ring: Column, places: int = 7) -> Column:
    """Mean of the corners, the closing one not counted, rounded."""
    own = corners_of(ring)
    n = F.size(own)
    mean = lambda k: F.round(F.aggregate(own, F.lit(0.0), lambda s, p: s + p[k]) / n, places)
    return F.when(n > 0, point(mean("lon"), mean("lat")))


def centroid(ring: Column, least: float = 0.0, degenerate: str = "first") -> Column:
    """Area centroid; where twice the area is not above ``least``, the first vertex or, with ``degenerate`` "null", null."""
    x0, y0 = F.get(ring, F.lit(0))["lon"], F.get(ring, F.lit(0))["lat"]
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"] - x0, e["a"]["lat"] - y0, e["b"]["lon"] - x0, e["b"]["lat"] - y0
        k = ax * by - bx * ay
        return F.struct((s["s"] + k).alias("s"), (s["x"] + (ax + bx) * k).alias("x"), (s["y"] + (ay + by) * k).alias("y"))

    total = F.aggregate(F.coalesce(pairs(ring), F.array().cast("array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>>>")), zero, add)
    there = F.abs(total["s"]) > least
    middle = point(x0 + total["x"] / (3 * total["s"]), y0 + total["y"] / (3 * total["s"]))
    return F.when(there, middle).otherwise(point(x0, y0) if degenerate == "first" else F.lit(None))


def extent(rings: Column, model: FlatModel = D7) -> Column:
    """STRUCT<lon, lat, half_width, half_height>: centre in degrees and half sizes in metres of everything in the rings; null without points."""
    xs, ys = (F.transform(F.flatten(rings), lambda p: p[k]) for k in ("lon", "lat"))
    west, east, south, north = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    told = F.struct(((west + east) / 2).alias("lon"), ((south + north) / 2).alias("lat"), ((east - west) / 2 * model.lon_m).alias("half_width"), ((north - south) / 2 * model.lat_m).alias("half_height"))
    return F.when(west.isNotNull() & south.isNotNull(), told)


def to_edge_m(lon: Column, lat: Column, ring: Column, model: FlatModel = D3) -> Column:
    """Metres from a point to the nearest edge of a ring or line; infinite without edges."""

    def away(e: Column) -> Column:
        ax, ay = (e["a"]["lon"] - lon) * model.lon_m, (e["a"]["lat"] - lat) * model.lat_m
        bx, by = (e["b"]["lon"] - lon) * model.lon_m, (e["b"]["lat"] - lat) * model.lat_m
        return geo.to_segment(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)

    return F.coalesce(F.array_min(F.transform(pairs(ring), away)), F.lit(INFINITE))


def to_area_m(lon: Column, lat: Column, rings: Column, model: FlatModel = D3) -> Column:
    """0 inside a polygon, else metres to its nearest edge, those of holes included."""
    edges = F.array_min(F.transform(rings, lambda r: to_edge_m(lon, lat, r, model)))
    return F.when(geo.in_polygon(lon, lat, rings), 0.0).otherwise(F.coalesce(edges, F.lit(INFINITE)))


def signed_m(lon: Column, lat: Column, ring: Column, model: FlatModel = D3) -> Column:
    """Metres to the nearest edge, positive inside the ring and negative outside."""
    away = to_edge_m(lon, lat, ring, model)
    return F.when(geo.in_ring(lon, lat, ring), away).otherwise(-away)


def _signed(px: np.ndarray, py: np.ndarray, ring: np.ndarray) -> np.ndarray:
    a, b = ring[:-1], ring[1:]
    d = b - a
    px, py = px[:, None], py[:, None]
    size = (d * d).sum(axis=1)
    t = np.clip(((px - a[:, 0]) * d[:, 0] + (py - a[:, 1]) * d[:, 1]) / np.where(size == 0, 1.0, size), 0.0, 1.0)
    near = np.hypot(px - a[:, 0] - t * d[:, 0], py - a[:, 1] - t * d[:, 1]).min(axis=1)
    rises = (a[:, 1] > py) != (b[:, 1] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        hits = rises & (px < d[:, 0] * (py - a[:, 1]) / d[:, 1] + a[:, 0])
    return np.where(hits.sum(axis=1) % 2 == 1, near, -near)


def deepest_point(ring: np.ndarray, grid: int = 24, precision: float = 0.4) -> tuple[float, float, float] | None:
    """(x, y, depth) of about the point farthest from all edges (metres): the best of a grid, then climbed in eight directions with halving steps."""
    low, high = ring.min(axis=0), ring.max(axis=0)
    size = high - low
    if (size < 1e-6).any():
        return None
    share = (np.arange(grid) + 0.5) / grid
    x, y = (m.ravel() for m in np.meshgrid(low[0] + share * size[0], low[1] + share * size[1], indexing="ij"))
    depth = _signed(x, y, ring)
    at = int(np.argmax(depth))
    best = (x[at], y[at], depth[at])
    step = size.max() / grid
    ways = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
    while step > precision:
        moved = False
        for dx, dy in ways:
            x, y = best[0] + dx * step, best[1] + dy * step
            d = _signed(np.array([x]), np.array([y]), ring)[0]
            if d > best[2]:
                best, moved = (x, y, d), True
        if not moved:
            step /= 2
    return best


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("lon", "lat", "radius")]))
def inner_pole(rings: pd.Series) -> pd.DataFrame:
    """The pole of inaccessibility of each ring with its depth in metres; nulls for rings without extent."""
    rows = []
    for ring in rings:
        found = None
        if ring is not None and len(ring) > 2:
            found = deepest_point(np.array([(p["lon"] * D3.lon_m, p["lat"] * D3.lat_m) for p in ring], float))
        rows.append((found[0] / D3.lon_m, found[1] / D3.lat_m, found[2]) if found else (None, None, None))
    return pd.DataFrame(rows, columns=["lon", "lat", "radius"])


def wound(ring: Column, exterior: bool | Column) -> Column:
    """The ring counter-clockwise if it is an exterior, clockwise if a hole."""
    left = geo.ring_area(ring) >= 0
    return F.when(left == (F.lit(exterior) if isinstance(exterior, bool) else exterior), ring).otherwise(F.reverse(ring))


def circle_ring(x: Column, y: Column, rx: Column, ry: Column, segments: int = 32) -> Column:
    """A closed ring of ``segments`` edges around an ellipse."""
    angle = lambda i: i.cast("double") * (2 * math.pi / segments)
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: point(x + rx * F.cos(angle(i)), y + ry * F.sin(angle(i))))


def bay_spine(ring: Column, model: FlatModel = FLAT_MODELS["D6"]) -> Column:
    """STRUCT<a, b, width> of a four-cornered ring: the midpoints of its two ends (the pair of opposite sides that is shorter) and their mean width; else null."""
    side = lambda i, j: model.metres(F.get(ring, F.lit(i))["lon"], F.get(ring, F.lit(i))["lat"], F.get(ring, F.lit(j))["lon"], F.get(ring, F.lit(j))["lat"])
    middle = lambda i, j: point((F.get(ring, F.lit(i))["lon"] + F.get(ring, F.lit(j))["lon"]) / 2, (F.get(ring, F.lit(i))["lat"] + F.get(ring, F.lit(j))["lat"]) / 2)
    one, other = side(0, 1) + side(2, 3), side(1, 2) + side(3, 0)
    told = lambda a, b, w: F.struct(a.alias("a"), b.alias("b"), F.round(w / 2, 2).alias("width"))
    return F.when(F.size(ring) == 5, F.when(one < other, told(middle(0, 1), middle(2, 3), one)).otherwise(told(middle(1, 2), middle(3, 0), other)))


def cross_param(e: Column, f: Column) -> Column:
    """Share of edge ``e`` (STRUCT<a, b>) at which edge ``f`` crosses it: ends of e excluded, ends of f included; null if they do not."""
    rx, ry = e["b"]["lon"] - e["a"]["lon"], e["b"]["lat"] - e["a"]["lat"]
    sx, sy = f["b"]["lon"] - f["a"]["lon"], f["b"]["lat"] - f["a"]["lat"]
    dx, dy = f["a"]["lon"] - e["a"]["lon"], f["a"]["lat"] - e["a"]["lat"]
    den = rx * sy - ry * sx
    safe = F.when(F.abs(den) >= 1e-15, den)
    t, u = (dx * sy - dy * sx) / safe, (dx * ry - dy * rx) / safe
    return F.when((t > 0) & (t < 1) & u.between(0, 1), t)


def pieces_by_ring(line: Column, ring: Column) -> Column:
    """ARRAY<STRUCT<a, b, inside>>: the line's segments cut wherever the ring crosses them, in order; inside by their middles."""

    def cut(e: Column) -> Column:
        met = F.filter(F.transform(pairs(ring), lambda f: cross_param(e, f)), lambda t: t.isNotNull())
        ts = F.array_sort(F.concat(F.array(F.lit(0.0)), met, F.array(F.lit(1.0))))
        at = lambda t: point(e["a"]["lon"] + t * (e["b"]["lon"] - e["a"]["lon"]), e["a"]["lat"] + t * (e["b"]["lat"] - e["a"]["lat"]))
        spans = F.transform(F.slice(ts, 2, F.size(ts) - 1), lambda t1, i: F.struct(F.get(ts, i).alias("t0"), t1.alias("t1")))
        long = F.filter(spans, lambda s: s["t1"] - s["t0"] >= 1e-12)
        return F.transform(long, lambda s: F.struct(at(s["t0"]).alias("a"), at(s["t1"]).alias("b"), geo.in_ring(at((s["t0"] + s["t1"]) / 2)["lon"], at((s["t0"] + s["t1"]) / 2)["lat"], ring).alias("inside")))

    return F.flatten(F.transform(pairs(line), cut))


def clipped(line: Column, ring: Column, outside: bool = False) -> Column:
    """ARRAY<ARRAY<point>>: the parts of a line inside a ring, or ``outside`` it; a line may fall into several."""
    wanted = F.filter(pieces_by_ring(line, ring), lambda p: ~p["inside"] if outside else p["inside"])
    none = F.array().cast("array<array<struct<lon:double,lat:double>>>")

    def add(runs: Column, p: Column) -> Column:
        last = F.element_at(runs, -1)
        end = F.element_at(last, -1)
        goes_on = (F.size(runs) > 0) & (end["lon"] == p["a"]["lon"]) & (end["lat"] == p["a"]["lat"])
        grown = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.concat(last, F.array(p["b"]))))
        return F.when(F.coalesce(goes_on, F.lit(False)), grown).otherwise(F.concat(runs, F.array(F.array(p["a"], p["b"]))))

    return F.aggregate(F.coalesce(wanted, F.array().cast("array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>,inside:boolean>>")), none, add)


def along_line(line: Column) -> Column:
    """Metres walked from the line's beginning to each of its points."""
    steps = F.transform(pairs(line), lambda e: geo.great_circle_m(e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + s)))


def nearest_on_line(lon: Column, lat: Column, line: Column) -> Column:
    """STRUCT<away, along, lon, lat>: the line's nearest point, metres to it, and metres along the line; the first of equals.

    Each segment is taken as straight in a plane scaled at the point's latitude; distances are great-circle.
    """
    scale = F.cos(F.radians(lat))
    walked = along_line(line)

    def foot(e: Column, i: Column) -> Column:
        dx, dy = (e["b"]["lon"] - e["a"]["lon"]) * scale, e["b"]["lat"] - e["a"]["lat"]
        size = dx * dx + dy * dy
        raw = ((lon - e["a"]["lon"]) * scale * dx + (lat - e["a"]["lat"]) * dy) / F.nullif(size, F.lit(0.0))
        t = F.coalesce(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        x, y = e["a"]["lon"] + t * (e["b"]["lon"] - e["a"]["lon"]), e["a"]["lat"] + t * (e["b"]["lat"] - e["a"]["lat"])
        along = F.get(walked, i) + geo.great_circle_m(e["a"]["lon"], e["a"]["lat"], x, y)
        return F.struct(geo.great_circle_m(lon, lat, x, y).alias("away"), along.alias("along"), x.alias("lon"), y.alias("lat"))

    return F.array_min(F.transform(pairs(line), foot))


def point_along(line: Column, metres: Column) -> Column:
    """The point so many metres from the line's beginning; its ends beyond them."""
    walked = along_line(line)
    spans = F.transform(pairs(line), lambda e, i: F.struct(e.alias("e"), F.get(walked, i).alias("from"), F.get(walked, i + 1).alias("to")))
    hit = F.get(F.filter(spans, lambda s: (s["to"] >= metres) & (s["to"] > s["from"])), F.lit(0))
    t = F.greatest(F.lit(0.0), (metres - hit["from"]) / (hit["to"] - hit["from"]))
    inner = point(hit["e"]["a"]["lon"] + t * (hit["e"]["b"]["lon"] - hit["e"]["a"]["lon"]), hit["e"]["a"]["lat"] + t * (hit["e"]["b"]["lat"] - hit["e"]["a"]["lat"]))
    return F.when(hit.isNotNull(), inner).otherwise(F.element_at(line, -1))


def longest_edge_deg(ring: Column) -> Column:
    """Angle of the longest edge (the first of equals), clockwise from east, turned to point east; 0 for rings of fewer than three points."""
    scale = F.cos(F.radians(F.get(ring, F.lit(0))["lat"]))

    def edge(e: Column, i: Column) -> Column:
        dx, dy = (e["b"]["lon"] - e["a"]["lon"]) * scale, e["b"]["lat"] - e["a"]["lat"]
        east = dx >= 0
        return F.struct((-F.hypot(dx, dy)).alias("order"), i.alias("i"), (-F.degrees(F.atan2(F.when(east, dy).otherwise(-dy), F.abs(dx)))).alias("angle"))

    return F.when(F.size(ring) >= 3, F.array_min(F.transform(pairs(ring), edge))["angle"]).otherwise(0.0)


def sharp_corners(ring: Column, least_deg: float = 25.0) -> Column:
    """The corners at which a closed ring turns by at least so many degrees."""
    own = corners_of(ring)
    n = F.size(own)

    def turn(p: Column, i: Column) -> Column:
        before, after = F.get(own, F.pmod(i - 1 + n, n)), F.get(own, F.pmod(i + 1, n))
        into, out = F.atan2(p["lat"] - before["lat"], p["lon"] - before["lon"]), F.atan2(after["lat"] - p["lat"], after["lon"] - p["lon"])
        raw = F.degrees(F.abs(out - into))
        return F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), F.when(raw > 180, 360 - raw).otherwise(raw).alias("turn"))

    kept = F.filter(F.transform(own, turn), lambda c: c["turn"] >= least_deg)
    return F.transform(kept, lambda c: point(c["lon"], c["lat"]))


def nested(rings: list[list[dict]]) -> list[list[list[dict]]]:
    """Rings sorted by area, each a hole of the first outline that holds its first point, else an outline of its own."""
    arrays = [np.array([(p["lon"], p["lat"]) for p in r], float) for r in rings]
    area = [abs(float((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum())) / 2 for a in arrays]
    groups: list[list[int]] = []
    for i in sorted(range(len(rings)), key=lambda k: -area[k]):
        x, y = arrays[i][0]
        host = next((g for g in groups if _signed(np.array([x]), np.array([y]), arrays[g[0]])[0] > 0), None)
        if host is None:
            groups.append([i])
        else:
            host.append(i)
    return [[rings[i] for i in g] for g in groups]


POINT = StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())])


@F.arrow_udf(ArrayType(ArrayType(ArrayType(POINT))))
def nested_polygons(rings: pa.Array) -> pa.Array:
    """The polygons that a shape's rings make: largest first, holes with their outline; rings of fewer than three points are dropped."""
    found = [None if rs is None else nested([r for r in rs if r is not None and len(r) >= 3]) for rs in rings.to_pylist()]
    return pa.array(found, pa.list_(pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))))
