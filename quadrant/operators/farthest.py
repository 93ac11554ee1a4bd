"""The largest distance between any two points of a group, without pairing them.

Every task keeps, group by group, only the corners of the convex hull of the points it has seen, so a group with a third of all rows is thinned before
it is shuffled; hulls of one group are then merged in a stream, and only corners are compared with corners. For a flat model whose scale follows the
latitude, corners are exact up to the change of that scale within the group.

Defined results: points with a null or out-of-range coordinate take no part; one point, or several at one place, spread 0; a group without
usable points has no row; null groups are a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrant.sources.tables import slots

#: Points of a group that are held before they are thinned to their hull.
HELD = 4_096


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) rows, by two sweeps over the sorted points."""
    points = np.unique(points, axis=0)
    if len(points) <= 3:
        return points

    def sweep(rows: np.ndarray) -> list:
        kept: list = []
        for x, y in rows.tolist():
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (y - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (x - kept[-2][0]):
                kept.pop()
            kept.append((x, y))
        return kept[:-1]

    return np.array(sweep(points) + sweep(points[::-1]))


def farthest_m(points: np.ndarray, lat_m: float = 111_320.0) -> float:
    """Largest distance of two points; a degree of longitude is taken at the first one's latitude, either being the first."""
    best = 0.0
    for i in range(0, len(points), 256):
        a = points[i : i + 256, None, :]
        d = points[None, :, :] - a
        best = max(best, float(np.hypot(d[..., 0] * lat_m * np.cos(np.radians(a[..., 1])), d[..., 1] * lat_m).max()))
    return best


def spread(frame: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, spread_m) of every group with a usable point."""
    kind = dict(frame.dtypes)[key]
    rows = frame.select(key, F.col(lon).alias("lon"), F.col(lat).alias("lat")).filter("lon between -180 and 180 and lat between -90 and 90")
    shape = f"{key} {kind}, lon double, lat double"

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy(zero_copy_only=False)
            points = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True])
            parts = [hull(points[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)] if len(code) else []
            if parts:
                who = np.repeat(code[order[cuts[:-1]]], [len(p) for p in parts])
                all_points = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(who)), pa.array(all_points[:, 0]), pa.array(all_points[:, 1])], names=[key, "lon", "lat"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, started = None, np.zeros((0, 2)), False
        for batch in batches:
            out, names = [], []
            for group, x, y in _runs(batch):
                if started and group != name:
                    names.append(name)
                    out.append(farthest_m(hull(held)))
                    held = np.zeros((0, 2))
                name, started = group, True
                held = np.concatenate([held, np.stack([x, y], axis=1)])
                if len(held) > HELD:
                    held = hull(held)
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(out, pa.float64())], names=[key, "spread_m"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([name], batch.schema.field(0).type), pa.array([farthest_m(hull(held))], pa.float64())], names=[key, "spread_m"])

    corners = rows.mapInArrow(thin, shape)
    return corners.repartition(slots(frame.sparkSession), key).sortWithinPartitions(key).mapInArrow(merge, f"{key} {kind}, spread_m double")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(group, lon, lat) of every run of equal groups in a batch sorted by them."""
    codes = batch.column(0).dictionary_encode(null_encoding="encode")
    code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
    x, y = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    cuts = np.flatnonzero(np.r_[True, np.diff(code) != 0, True]) if len(code) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield names[code[a]], x[a:b], y[a:b]
