"""A small end-to-end run: resume, baseline, refusal of mixed granularity, exit code."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import run, schemas
from driftline.sources.io import Store


@pytest.fixture()
def stores(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for i in range(10):
        day = dt.date(2024, 1, 10) + dt.timedelta(i)
        for site in ("a", "b"):
            for j in range(24):
                k += 1
                slow = 30.0 if site == "b" and i == 9 else 0.0
                rows.append((str(k), day, f"192.0.2.{j % 8}", 65, "X-Y-US", site, float(40 + rng.normal() + slow), 0.0, 10.0, None, None, "v4"))
    s = Store(spark, f"file://{tmp_path}/in")
    # two routes from each site; the slow day of site b goes over the second network
    hops = []
    for r in rows:
        slow = r[5] == "b" and r[1] == dt.date(2024, 1, 19)
        middle = "198.51.100.9" if slow else "198.51.100.1"
        hops += [(r[0], False, None, 2, middle, None, 10.0, "x"), (r[0], False, None, 3, "203.0.113.5", None, 20.0 + 30 * slow, r[2])]
        if int(r[0]) % 10 == 0:  # the better trace of some
            hops += [(r[0], True, 1, 2, middle, None, 9.0, "x"), (r[0], True, 1, 3, "203.0.113.5", None, 19.0 + 30 * slow, r[2]), (r[0], True, 2, 2, "*", None, None, "x")]
    spark.createDataFrame(hops, "id string, multipath boolean, flow int, ttl int, addr string, name string, rtt double, link string").write.parquet(s.path("traces"))
    number = lambda a: sum(int(x) << 8 * (3 - i) for i, x in enumerate(a.split(".")))
    spark.createDataFrame([(number("198.51.100.0"), 24, 64496), (number("198.51.100.8"), 30, 64497), (number("203.0.113.0"), 24, 64498), (number("192.0.2.0"), 24, 64499)], "network long, mask long, asn long").write.parquet(s.path("prefixes"))
    spark.createDataFrame([("203.0.113.77", 64500, "ix")], "ip string, asn long, name string").write.parquet(s.path("exchanges"))
    at = [("198.51.100.1", 0.0, "m1"), ("198.51.100.9", 5.0, "m2"), ("203.0.113.5", 10.0, "m3"), *[(f"192.0.2.{j}", 11.0, "m4") for j in range(8)]]
    spark.createDataFrame([(a, x, 50.0, m) for a, x, m in at], "ip string, lon double, lat double, metro string").write.parquet(s.path("places"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.MERGED.fields[:-1])
    spark.createDataFrame(rows, names).write.parquet(s.path("tests"))
    return Store(spark, s.root, read_only=True), Store(spark, f"file://{tmp_path}/out")


def test_run(stores):
    tests, out = stores
    assert run.run(tests, out, ["2024-01-19"]) == {}
    assert out.days("merged") == [f"2024-01-{d}" for d in range(12, 20)]
    flags = {r["site"]: r["anomaly_rtt"] for r in out.day("anomalies", "2024-01-19").collect()}
    assert flags == {"a": 0, "b": 1}
    path = [(r["addr"], r["rtt"]) for r in out.day("paths", "2024-01-19").where("id = '480'").orderBy("ttl").collect()]
    mapped = out.day("mapped", "2024-01-19")
    assert {r["asn"] for r in mapped.where("anomalous and ttl = 2").collect()} == {64497} and {r["asn"] for r in mapped.where("not anomalous and ttl = 2").collect()} == {64496}
    assert path == [("b", 0.0), ("198.51.100.9", 9.0), ("203.0.113.5", 49.0), ("192.0.2.7", 49.0)] and mapped.where("ttl = 4 and asn = 64499 and path_km > 0").count() > 0
    culprits = out.day("culprits", "2024-01-19").collect()
    assert culprits == [] or culprits[0]["pairs"] >= 2  # one pair alone is no culprit's
    assert out.day("entities", "2024-01-19").where("entity = '64497-m2'").first()["h"] == 0
    verdicts = {r["pair"]: r["verdict"] for r in out.day("verdicts", "2024-01-19").collect()}
    assert verdicts == {"65 - X-Y-US - a": "congestion_in_place", "65 - X-Y-US - b": "reroute"}
    events = out.day("events", "2024-01-19").collect()
    assert [(r["pair"], r["n_dayof"], r["location"]) for r in events] == [("65 - X-Y-US - b", 24, "unresolved")]
    before = out.read("anomalies").count()
    assert run.run(tests, out, ["2024-01-19"]) == {} and run.run(tests, out, ["2024-01-19"], rerun=True) == {}
    assert out.read("anomalies").count() == before
    assert "granularity" in run.run(tests, out, ["2024-01-19"], granularity="metro")["2024-01-19"]
    assert run.audit(out).count() == 0
    assert schemas.create_all(out) == []
    assert run.main(["--tests", tests.root, "--out", out.root, "--start", "2024-01-19", "--stage", "events"]) == 0
    assert out.read("events").where(F.col("site") == "b").count() == 1
    # a stage alone honours the granularity too
    assert run.main(["--tests", tests.root, "--out", out.root, "--start", "2024-01-19", "--stage", "events", "--granularity", "metro"]) == 1
    assert run.main(["--tests", tests.root, "--out", out.root, "--start", "2024-01-18", "--stage", "anomalies", "--granularity", "metro"]) == 0
    assert {r["granularity"] for r in out.day("anomalies", "2024-01-18").collect()} == {"metro"}
