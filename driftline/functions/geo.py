"""Spherical geometry. Points are (lon, lat) in degrees; distances are in kilometres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean Earth radius.
RADIUS_KM = 6371.0088


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance; null without all four coordinates."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # not least(), which skips nulls and would make them half the way around
    return 2 * RADIUS_KM * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def detour(path_km: Column, straight_km: Column) -> Column:
    return F.try_divide(path_km, straight_km)


def cell(lon: Column, lat: Column, size: float) -> tuple[Column, Column]:
    """Grid cell of a point, the key of spatial equi-joins."""
    return F.floor((lon + 180) / size).cast("int"), F.floor((lat + 90) / size).cast("int")


def metro_name(city: Column, state: Column, iso2: Column, country: Column) -> Column:
    """``City-State-CC`` with white space collapsed."""
    return F.regexp_replace(F.trim(F.concat(city, F.lit("-"), F.coalesce(state, iso2, F.lit("NA")), F.lit("-"), country)), r"\s+", " ")


def unit(lon, lat) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def arc_km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distance of unit vectors."""
    return RADIUS_KM * np.arccos(np.clip((a * b).sum(axis=-1), -1.0, 1.0))


def densify(ring: np.ndarray, step: float = 0.25) -> np.ndarray:
    """A closed ring of (lon, lat) with points added along great circles, no edge over ``step`` degrees."""
    out = []
    for p, q in zip(ring[:-1], ring[1:]):
        a, b = unit(*p), unit(*q)
        angle = np.degrees(np.arccos(np.clip(a @ b, -1, 1)))
        n = max(1, int(np.ceil(angle / step)))
        t = np.linspace(0, 1, n, endpoint=False)[:, None]
        v = a * (1 - t) + b * t
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        out.append(np.stack([np.degrees(np.arctan2(v[:, 1], v[:, 0])), np.degrees(np.arcsin(np.clip(v[:, 2], -1, 1)))], axis=1))
    return np.concatenate([*out, ring[-1:]])


def area_km2(ring: np.ndarray) -> float:
    """Area of a closed ring by spherical excess, edges taken along the given points."""
    lon, lat = np.radians(ring[:, 0]), np.radians(ring[:, 1])
    turn = np.diff(lon)
    turn = (turn + np.pi) % (2 * np.pi) - np.pi
    excess = 2 * np.arctan2(np.tan(turn / 2) * (np.sin((lat[:-1] + lat[1:]) / 2)), np.cos((lat[:-1] - lat[1:]) / 2))
    return float(abs(excess.sum()) * RADIUS_KM**2)


def split_antimeridian(ring: np.ndarray) -> list[np.ndarray]:
    """Rings within [-180, 180] that together cover a ring whose edges may cross the date line."""
    lon = np.concatenate([[ring[0, 0]], ring[0, 0] + np.cumsum((np.diff(ring[:, 0]) + 180) % 360 - 180)])
    flat = np.stack([lon, ring[:, 1]], axis=1)
    out = []
    for k in range(int(np.floor((lon.min() + 180) / 360)), int(np.floor((lon.max() + 180 - 1e-12) / 360)) + 1):
        part = flat
        for edge, keep_over in ((360 * k - 180, True), (360 * k + 180, False)):
            part = _clip(part, edge, keep_over)
            if len(part) < 4:
                break
        if len(part) >= 4:
            out.append(part - np.array([360.0 * k, 0.0]))
    return out


def _clip(ring: np.ndarray, edge: float, keep_over: bool) -> np.ndarray:
    """Half-plane clip of a closed ring at a meridian."""
    out = []
    for p, q in zip(ring[:-1], ring[1:]):
        a, b = ((p[0] >= edge) == keep_over) or p[0] == edge, ((q[0] >= edge) == keep_over) or q[0] == edge
        if a:
            out.append(p)
        if a != b:
            t = (edge - p[0]) / (q[0] - p[0])
            out.append(np.array([edge, p[1] + t * (q[1] - p[1])]))
    return np.array([*out, out[0]]) if out else np.empty((0, 2))


def rotate_pole(lon, lat):
    """Rigid rotation that takes the north pole to the equator at longitude 0, and back by its inverse."""
    v = unit(lon, lat)
    w = np.stack([v[..., 2], v[..., 1], -v[..., 0]], axis=-1)
    return np.degrees(np.arctan2(w[..., 1], w[..., 0])), np.degrees(np.arcsin(np.clip(w[..., 2], -1, 1)))


def unrotate_pole(lon, lat):
    v = unit(lon, lat)
    w = np.stack([-v[..., 2], v[..., 1], v[..., 0]], axis=-1)
    return np.degrees(np.arctan2(w[..., 1], w[..., 0])), np.degrees(np.arcsin(np.clip(w[..., 2], -1, 1)))


def inside(ring: np.ndarray, lon: np.ndarray, lat: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Whether points lie in a closed ring (or on it); long edges should be densified first."""
    x1, y1, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
    px, py = lon[:, None], lat[:, None]
    between = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = px < (x2 - x1) * (py - y1) / (y2 - y1) + x1
    hit = (between & cross).sum(axis=1) % 2 == 1
    line = np.abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= tolerance
    on = line & (px >= np.minimum(x1, x2) - tolerance) & (px <= np.maximum(x1, x2) + tolerance) & (py >= np.minimum(y1, y2) - tolerance) & (py <= np.maximum(y1, y2) + tolerance)
    return hit | on.any(axis=1)


@F.pandas_udf(T.BooleanType())
def covers(ring_lon: pd.Series, ring_lat: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Whether the densified ring covers the point; null without a ring or point. A ring is densified once
    for all its points of a batch."""
    rings, rows, out = {}, {}, [None] * len(lon)
    for i, (rx, ry, x, y) in enumerate(zip(ring_lon, ring_lat, lon, lat)):
        if rx is not None and ry is not None and not pd.isna(x) and not pd.isna(y):
            ring = np.stack([np.asarray(rx, float), np.asarray(ry, float)], axis=1)
            rings.setdefault(ring.tobytes(), ring)
            rows.setdefault(ring.tobytes(), []).append(i)
    x, y = lon.to_numpy(float, na_value=np.nan), lat.to_numpy(float, na_value=np.nan)
    for key, at in rows.items():
        for i, hit in zip(at, inside(densify(rings[key]), x[at], y[at])):
            out[i] = bool(hit)
    return pd.Series(out, dtype="object")
