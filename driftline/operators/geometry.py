"""Metro cells: containment with tolerance, tiered lookup, nearest-seed tessellation, population."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import geo
from driftline.operators.joins import near_seeds


def assign(points: DataFrame, cells: DataFrame, tolerance_km: float = 100.0, size: float = 5.0) -> DataFrame:
    """(lon, lat, metro_id, covered): the cell that covers a point or lies within the tolerance;
    covering cells first, then the nearer seed, then the id.

    ``cells`` has metro_id, seed_lon, seed_lat, ring_lon, ring_lat (closed rings). Only distinct points
    are resolved. Candidates are cells whose ring's box, widened by the tolerance, shares a grid cell
    with the point: an equi-join; the exact test runs on those.
    """
    distinct = points.select("lon", "lat").where("lon is not null and lat is not null").distinct()
    pad = tolerance_km / 111.0
    box = cells.withColumns({"x0": F.array_min("ring_lon"), "x1": F.array_max("ring_lon"), "y0": F.array_min("ring_lat") - pad, "y1": F.array_max("ring_lat") + pad})
    # a degree of longitude shrinks with the cosine of the latitude; near a pole every longitude counts
    widest = F.greatest(F.abs("y0"), F.abs("y1"))
    wide = F.when(widest >= 85, F.lit(360.0)).otherwise(F.lit(pad) / F.cos(F.radians(F.least(widest, F.lit(85.0)))))
    box = box.withColumns({"x0": F.col("x0") - wide, "x1": F.col("x1") + wide})
    n = round(360 / size)
    cx = F.explode(F.sequence(F.floor((F.col("x0") + 180) / size).cast("int"), F.least(F.floor((F.col("x0") + 180) / size) + n - 1, F.floor((F.col("x1") + 180) / size)).cast("int")))
    cy = F.explode(F.sequence(F.floor((F.greatest("y0", F.lit(-90.0)) + 90) / size).cast("int"), F.floor((F.least("y1", F.lit(90.0)) + 90) / size).cast("int")))
    keyed = box.withColumn("cx", cx).withColumn("cy", cy).withColumn("cx", F.pmod("cx", F.lit(n))).drop("x0", "x1", "y0", "y1")
    px, py = geo.cell(F.col("lon"), F.col("lat"), size)
    met = distinct.withColumns({"cx": F.pmod(px, F.lit(n)), "cy": py}).join(keyed, ["cx", "cy"])
    met = met.withColumn("edge_km", ring_distance(F.col("ring_lon"), F.col("ring_lat"), F.col("lon"), F.col("lat"))).where(F.col("edge_km") <= tolerance_km)
    km = geo.distance(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat"))
    best = met.groupBy("lon", "lat").agg(F.min(F.struct((F.col("edge_km") > 0).alias("outside"), km.alias("km"), "metro_id")).alias("b"))
    return best.select("lon", "lat", F.col("b.metro_id").alias("metro_id"), (~F.col("b.outside")).alias("covered"))


@F.pandas_udf(T.DoubleType())
def ring_distance(ring_lon: pd.Series, ring_lat: pd.Series, lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Kilometres from a point to a densified ring, 0 inside. The rows of a batch are gathered by ring; each
    ring is densified once and tested against all its points at once."""
    rows: dict[bytes, list[int]] = {}
    rings: dict[bytes, np.ndarray] = {}
    for i, (rx, ry) in enumerate(zip(ring_lon, ring_lat)):
        ring = np.stack([np.asarray(rx, float), np.asarray(ry, float)], axis=1)
        key = ring.tobytes()
        rings.setdefault(key, ring)
        rows.setdefault(key, []).append(i)
    x, y, out = lon.to_numpy(float), lat.to_numpy(float), np.zeros(len(lon))
    for key, at in rows.items():
        ring = geo.densify(rings[key])
        edge = geo.unit(ring[:, 0], ring[:, 1])
        for a in range(0, len(at), 256):  # a bounded table of points by ring vertices
            some = np.array(at[a : a + 256])
            outside = some[~geo.inside(ring, x[some], y[some])]
            if len(outside):
                out[outside] = geo.arc_km(edge[None, :, :], geo.unit(x[outside], y[outside])[:, None, :]).min(axis=1)
    return pd.Series(out, dtype="float64")


def tiered(points: DataFrame, seeds: DataFrame, far_km: float = 100.0) -> DataFrame:
    """(point columns, metro_id, method) for points with country and maybe state: nearest seed of the
    state, else of the country (``_far`` beyond the limit), else none. Ties go to metro_id.

    A cell is by construction the set of points nearest to its seed in its unit, so no ring is needed
    where the unit is known."""
    s = seeds.select("metro_id", F.col("country").alias("s_country"), F.col("state").alias("s_state"), "seed_lon", "seed_lat")
    km = geo.distance(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat"))
    best = lambda d: d.groupBy("point").agg(F.min(F.struct(km.alias("km"), "metro_id")).alias("b"))
    by_state = best(points.join(s, (F.col("country") == F.col("s_country")) & (F.col("state") == F.col("s_state")))).select("point", F.col("b").alias("bs"))
    by_country = best(points.join(s, F.col("country") == F.col("s_country"))).select("point", F.col("b").alias("bc"))
    met = points.join(by_state, "point", "left").join(by_country, "point", "left")
    far = F.when(F.col("bc.km") > far_km, "country_nearest_far").otherwise("country_nearest")
    method = F.when(F.col("bs").isNotNull(), "state_nearest").when(F.col("bc").isNotNull(), far).otherwise("no_country_cells")
    return met.select(*points.columns, F.coalesce("bs.metro_id", "bc.metro_id").alias("metro_id"), method.alias("method"))


def population(cells_of_grid: DataFrame, metros: DataFrame) -> DataFrame:
    """Rounded population of every metro from (metro_id, population) grid cells; 0 where none is."""
    total = cells_of_grid.where("population > 0").groupBy("metro_id").agg(F.round(F.sum("population")).cast("long").alias("population"))
    return metros.select("metro_id").join(total, "metro_id", "left").select("metro_id", F.coalesce("population", F.lit(0)).alias("population"))


def voronoi(seeds: DataFrame, step: float = 1.0) -> DataFrame:
    """(country, metro_id, ring_lon, ring_lat): per country the spherical nearest-seed cell of each seed
    inside the country's box, by clipping the box with the bisectors of the other seeds in a gnomonic
    plane about the seed; seeds farther than twice the cell's radius are skipped."""

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("metro_id")
        v = geo.unit(pdf["seed_lon"].to_numpy(), pdf["seed_lat"].to_numpy())
        out = []
        for i, r in enumerate(pdf.itertuples()):
            c = v[i]
            east = np.array([-np.sin(np.radians(r.seed_lon)), np.cos(np.radians(r.seed_lon)), 0.0])
            north = np.cross(c, east)
            edge = np.array([[r.x0, r.y0], [r.x1, r.y0], [r.x1, r.y1], [r.x0, r.y1], [r.x0, r.y0]], float)
            w = geo.unit(*geo.densify(edge, step)[:-1].T)
            w = w[w @ c > 0.05]
            poly = np.stack([(w @ east) / (w @ c), (w @ north) / (w @ c)], axis=1)
            order = np.argsort(-(v @ c))
            for j in order:
                if j == i or len(poly) < 3:
                    continue
                radius = np.arctan(np.sqrt((poly**2).sum(axis=1).max()))
                if np.arccos(np.clip(v[j] @ c, -1, 1)) > 2 * radius:
                    break
                n = c - v[j]  # points with n . p >= 0 are nearer to the seed
                a, b, d = n @ east, n @ north, n @ c
                poly = _half_plane(poly, a, b, d)
            if len(poly) >= 3:
                p = c + poly[:, :1] * east + poly[:, 1:] * north
                p /= np.linalg.norm(p, axis=1, keepdims=True)
                lon, lat = np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1)))
                out.append((r.country, r.metro_id, [*lon, lon[0]], [*lat, lat[0]]))
        return pd.DataFrame(out, columns=["country", "metro_id", "ring_lon", "ring_lat"])

    return seeds.groupBy("country").applyInPandas(cells, "country string, metro_id string, ring_lon array<double>, ring_lat array<double>")


def _half_plane(poly: np.ndarray, a: float, b: float, d: float) -> np.ndarray:
    """Clip a polygon to a x + b y + d >= 0."""
    s = poly @ np.array([a, b]) + d
    out = []
    for k in range(len(poly)):
        m = (k + 1) % len(poly)
        if s[k] >= 0:
            out.append(poly[k])
        if (s[k] >= 0) != (s[m] >= 0):
            t = s[k] / (s[k] - s[m])
            out.append(poly[k] + t * (poly[m] - poly[k]))
    return np.array(out) if out else np.empty((0, 2))


def seed_problems(seeds: DataFrame, near_km: float = 5.0) -> DataFrame:
    """(kind, metro_id): invalid coordinates, repeated ids, near-duplicates in one country."""
    bad = seeds.where(F.col("seed_lon").isNull() | F.col("seed_lat").isNull() | (F.abs("seed_lon") > 180) | (F.abs("seed_lat") > 90)).select(F.lit("invalid").alias("kind"), "metro_id")
    twice = seeds.groupBy("metro_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("kind"), "metro_id")
    other = seeds.select(F.col("metro_id").alias("o"), F.col("country").alias("oc"), "seed_lon", "seed_lat")
    met = near_seeds(seeds.select("metro_id", "country", F.col("seed_lon").alias("lon"), F.col("seed_lat").alias("lat")), other, near_km)
    close = met.where((F.col("metro_id") < F.col("o")) & (F.col("country") == F.col("oc")) & (geo.distance(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat")) <= near_km))
    return bad.unionByName(twice).unionByName(close.select(F.lit("near").alias("kind"), "metro_id").distinct())


def disagreement(old: DataFrame, new: DataFrame) -> DataFrame:
    """How two assignments of (point, metro_id) differ, by category."""
    met = old.withColumnRenamed("metro_id", "a").join(new.withColumnRenamed("metro_id", "b"), "point", "full_outer")
    kind = F.when(F.col("a").isNull() & F.col("b").isNull(), "both_null").when(F.col("a").isNull(), "filled").when(F.col("b").isNull(), "lost").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return met.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
