"""Published values of the statistics, address and geometry functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import compat, geo, ip, stats
from driftline.plans import detect

BASE = [10.0, 11.0, 12.0, 10.5, 11.5, 10.0, 12.0]
NOW = [20.0, 21.0, 19.5, 22.0, 20.5, 21.5, 20.0]


def frame(spark):
    rows = [("g", float(x), 1) for x in BASE] + [("g", float(x), 2) for x in NOW]
    return spark.createDataFrame(rows, "g string, x double, side int")


def test_golden_mann_whitney_and_distance(spark):
    f = frame(spark)
    r = detect.rank_tests(f.where("side = 1"), f.where("side = 2"), ["g"], "x").first()
    m = r["mwu"]
    assert m["U"] == 0 and m["meanU"] == 24.5
    assert m["Z"] == pytest.approx(-3.2049661212218012, rel=1e-9)
    assert m["p_value"] == pytest.approx(0.001350911636945007, rel=1e-9)
    assert m["stdU"] == pytest.approx(7.800394467342908, rel=1e-9)
    assert r["distance"] == pytest.approx(9.642857142857139, rel=1e-9)


def test_golden_welch(spark):
    f = frame(spark)
    g = f.groupBy("side").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    a, b = (g.where(f"side = {i}").select(*[F.col(c).alias(f"{c}{i}") for c in "nmv"]) for i in (1, 2))
    w = a.crossJoin(b).select(stats.welch(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")]).alias("w")).select("w.*")
    r = w.select("*", stats.welch_p(F.col("t_stat"), F.col("degrees_of_freedom")).alias("p_value")).first()
    assert r["t_stat"] == pytest.approx(-20.42954752836539, rel=1e-9)
    assert r["degrees_of_freedom"] == pytest.approx(11.982543931106713, rel=1e-9)
    assert r["p_value"] == pytest.approx(1.1139644762181433e-10, rel=1e-9)
    assert r["se1"] == pytest.approx(0.32732683535398854, rel=1e-9)
    assert r["se2"] == pytest.approx(0.34006802040680234, rel=1e-9)


def test_constant_samples_are_significant(spark):
    f = spark.createDataFrame([("g", 1.0, s) for s in (1, 1, 1, 2, 2, 2)], "g string, x double, side int")
    m = detect.rank_tests(f.where("side = 1"), f.where("side = 2"), ["g"], "x").first()["mwu"]
    assert m["Z"] == float("-inf") and m["p_value"] == 0.0


def test_wasserstein_arrow(spark):
    d = spark.createDataFrame([(BASE, NOW), ([], NOW)], "a array<double>, b array<double>")
    r = d.select(stats.wasserstein("a", "b", F.lit(100)).alias("w")).collect()
    assert r[0]["w"]["distance"] == pytest.approx(9.642857142857139) and r[0]["w"]["p_value"] < 0.05
    assert (r[1]["w"]["distance"], r[1]["w"]["p_value"]) == (0.0, 1.0)


def test_fisher():
    assert stats.fisher(8, 10, 1, 6)[0] == pytest.approx(0.02447552447552449)
    assert stats.fisher(0, 5, 0, 5)[0] == pytest.approx(1.0)
    assert stats.fisher(5, 5, 0, 5)[1] == math.inf


def test_verdict_arithmetic(spark):
    d = spark.createDataFrame([(0.8, 0.1, 20, 20), (0.1, 0.7, 20, 20), (0.05, 0.0, 20, 20), (0.8, 0.1, 2, 20), (0.8, 0.1, 20, 1)], "f double, r double, h int, n int")
    what, way = stats.verdict(F.col("f"), F.col("r"), F.col("h"), F.col("n"), tau=0.3)
    assert [tuple(x) for x in d.select(what, way).collect()] == [("reroute", "forward"), ("reroute", "reverse"), ("congestion_in_place", "forward"), ("indeterminate", None), ("indeterminate", None)]
    e = spark.createDataFrame([("b-x", None, 1.0), ("b-c", 1.0, None), ("a-b", 1.0, 1.0)], "e string, u double, d double")
    assert [x[0] for x in e.select(stats.edge_label(F.col("u"), F.col("d"), 0.5)).collect()] == ["diverted", "abandoned", "stable"]


def test_compat(spark):
    r = spark.range(1).select(
        compat.strict_greatest(F.lit(1), F.lit(None)).alias("g"), compat.over(F.lit(float("nan")), 1.6).alias("n"), compat.count_or_null(F.array()).alias("c"),
        F.size(compat.sequence0(F.lit(0), F.lit(-1))).alias("s"), compat.sequence0(F.lit(0), F.lit(None)).alias("z"), compat.finite(F.lit(float("inf"))).alias("f"),
        compat.drop_last_parts(F.lit("Winston-Salem-NC-US")).alias("d"), compat.strip_suffix(F.lit("A-B-C"), F.lit("-B-C")).alias("x"), compat.extract(F.lit("abc"), "([0-9])").alias("e"),
    ).first()
    assert tuple(r) == (None, False, None, 0, None, None, "Winston-Salem", "A", None)


def test_addresses(spark):
    d = spark.createDataFrame([("10.1.2.3",), ("256.1.1.1",), ("2001:db8::1",), ("x",), (None,)], "a string")
    r = d.select("a", ip.parse_v4(F.col("a")).alias("n"), ip.parse("a").alias("p")).collect()
    assert [x["n"] for x in r] == [167838211, None, None, None, None]
    assert [x["p"]["len"] for x in r] == [4, None, 16, None, None]
    v6 = spark.createDataFrame([("fe80::1", True), ("fd00::1", False), ("fc00::1", True), ("2001:db8::9", True), ("2600::1", False)], "a string, want boolean")
    q = v6.select("want", ip.parse("a").alias("p")).select("want", ip.private_v6(F.col("p.hi"), F.col("p.lo")).alias("got")).collect()
    assert all(x["want"] == x["got"] for x in q)


def test_geometry():
    assert geo.arc_km(geo.unit(179.0, 0.0), geo.unit(-179.0, 0.0)) == pytest.approx(2 * math.pi * geo.RADIUS_KM / 180)
    ring = np.array([[170, -10], [190, -10], [190, 10], [170, 10], [170, -10]], float)
    parts = geo.split_antimeridian(geo.densify(ring))
    assert len(parts) == 2 and all(p[:, 0].min() >= -180 and p[:, 0].max() <= 180 for p in parts)
    whole = geo.area_km2(geo.densify(ring))
    assert sum(geo.area_km2(geo.densify(p)) for p in parts) == pytest.approx(whole, rel=1e-4)
    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(-180, 180, 200), rng.uniform(-89, 89, 200)
    back = geo.unrotate_pole(*geo.rotate_pole(lon, lat))
    assert np.allclose(geo.unit(*back), geo.unit(lon, lat))
    box = geo.densify(np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float))
    assert geo.inside(box, np.array([5.0, 15.0, 0.0]), np.array([5.0, 5.0, 5.0])).tolist() == [True, False, True]


def test_distance_of_unknown_points_is_unknown(spark):
    from driftline.functions import geo

    d = spark.createDataFrame([(0.0, 0.0, 180.0, 0.0), (None, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, None)], "a double, b double, c double, d double")
    got = [r["km"] for r in d.select(geo.distance(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km")).collect()]
    assert got[0] == pytest.approx(math.pi * geo.RADIUS_KM) and got[1:] == [None, None]


def test_large_samples_are_tested(spark):
    """Two samples of 30,000 values that are nearly alike are not taken for different by their size."""
    n = F.lit(30000.0)
    got = spark.range(1).select(stats.mann_whitney(n, n, n * (2 * n + 1) / 2 - 1000, F.lit(0.0)).alias("m")).first()["m"]
    assert got["U"] == 449_999_000 and got["p_value"] > 0.9
