"""Great-circle helpers on a sphere, vectorised."""

from __future__ import annotations

import numpy as np

#: Mean Earth radius in metres.
EARTH_M = 6371008.8


def great_circle(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Distance in metres between points given in radians (haversine)."""
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Rows (x, y, z) for points in radians."""
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def inside_rings(lon: np.ndarray, lat: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Whether each point is inside ring 0 and in none of the others (even-odd rule, edges straight in lon/lat)."""
    result = _inside(lon, lat, rings[0])
    for hole in rings[1:]:
        at = np.flatnonzero(result)
        if len(at):
            result[at] &= ~_inside(lon[at], lat[at], hole)
    return result


def _inside(lon: np.ndarray, lat: np.ndarray, ring: np.ndarray) -> np.ndarray:
    odd = np.zeros(len(lon), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if y1 != y2:
            crosses = (lat < y1) != (lat < y2)
            odd ^= crosses & (lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1))
    return odd
