"""Plans on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import geometry, joins, paths
from driftline.plans import detect, publish, tomography, traces


def test_edge_prevalence_verdicts(spark):
    rows = [("G1", "a-b", 1.0, 1.0, 10.0, 10.0), ("G1", "b-c", 1.0, 0.0, 12.0, 12.0), ("G1", "b-x", 0.0, 1.0, None, 90.0), ("G2", "k-m", 1.0, 1.0, 10.0, 11.0), ("G2", "m-n", 1.0, 1.0, 15.0, 85.0)]
    p = spark.createDataFrame([(*r, 20, 20, "forward") for r in rows], "pair string, edge string, prev_u double, prev_d double, base_rtt double, day_rtt double, healthy_n long, dayof_n long, direction string")
    v = tomography.verdicts(p, ["pair"])
    told = tomography.agrees(v, spark.createDataFrame([("G1", "x-b")], "pair string, edge string"), ["pair"])
    got = {r["pair"]: (r["verdict"], r["changed_segment"], r["congested_segment"], r["agrees_with_culprit"]) for r in told.collect()}
    assert got == {"G1": ("reroute", "b-x", None, True), "G2": ("congestion_in_place", None, "m-n", False)}


def test_trim_keeps_at_most_the_share(spark):
    d = spark.createDataFrame([("g", 1, i) for i in range(8)] + [("g", 2, 8), ("g", 3, 9), ("h", 1, 10), ("h", 2, 11)], "g string, ip int, id int")
    kept = paths.trim_dominant(d, ["g"], "ip", "id").collect()
    assert sorted(r["id"] for r in kept) == [0, 1, 2, 3, 8, 9]


def test_detection_end_to_end(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for site, rise in (("a", 0.0), ("b", 20.0)):
        for day in range(13, 21):
            for i in range(30):
                k += 1
                rows.append((k, f"2024-01-{day:02d}", i % 10, site, float(50 + rng.normal() + (rise if day == 20 else 0)), 0.0 if day < 20 or site == "a" else 0.2, 1))
    m = spark.createDataFrame(rows, "id long, d string, ip int, site string, rtt double, loss double, asn int").withColumn("day", F.to_date("d"))
    cfg = detect.Detection(day="2024-01-20")
    got = {r["site"]: (r["anomaly_rtt"], r["anomaly_loss"]) for r in detect.detect(m, cfg).collect()}
    assert got == {"a": (0, 0), "b": (1, 1)}


def test_set_cover_explains_each_pair_once(spark):
    edges, ms, k = [], [], 0
    for pair in range(12):
        for kind in ("anomalous", "healthy"):
            for _ in range(4):
                k += 1
                ms.append((k, f"p{pair}", kind))
                edges.append((k, "common"))
                if kind == "anomalous":
                    edges.append((k, "bad" if pair < 8 else "worse"))
    e, m = spark.createDataFrame(edges, "id long, edge string"), spark.createDataFrame(ms, "id long, pair string, path_type string")
    picks, explained = tomography.greedy_cover(e, m)
    assert [p["edge"] for p in picks] == ["bad", "worse"]
    assert explained.groupBy("pair").count().where("count > 1").count() == 0 and explained.count() == 12


def _plain_cover(uses, children, least=2, most_p=0.01, odds=1.5, floor=0.1):
    """The cover over sets of paths, one step after another; returns what each step took."""
    from driftline.functions import stats

    through, of, bad = {}, {}, {}
    for i, pair, gran, entity, anomalous in uses:
        through.setdefault((gran, entity), set()).add(i)
        of[i], bad[i] = pair, anomalous
    count = lambda e, ids: (len([i for i in through[e] if i in ids and bad[i]]), len([i for i in through[e] if i in ids and not bad[i]]))
    every = set(of)
    totals = lambda ids: (sum(bad[i] for i in ids), sum(not bad[i] for i in ids))
    pool = []
    for e in through:
        a, h = count(e, every)
        if a >= least and a / (a + h) >= floor:
            p, o = stats.fisher(a, totals(every)[0], h, totals(every)[1])
            if p <= most_p and o >= odds:
                pool.append(e)
    goal, open_, out = len({of[i] for i in every if bad[i]}), set(every), []
    rank = {"edge": 0, "node": 1, "as": 2, "metro": 2, "ixp": 2}
    while goal and len({of[i] for i in open_ if bad[i]}) > 0.02 * goal:
        pairs = lambda e: {of[i] for i in through[e] if i in open_ and bad[i]}
        pure = lambda e: count(e, open_)[0] / max(1, sum(count(e, open_)))
        fine = [e for e in pool if count(e, open_)[0] >= least and pure(e) >= floor and len(pairs(e)) >= least]
        if not fine:
            break
        best = min(fine, key=lambda e: (-len(pairs(e)), -pure(e), rank[e[0]], e[1]))
        taken, demoted = best, None
        if rank[best[0]] == 2:
            kids = [("node", n) for g, x, n in children if (g, x) == best and ("node", n) in pool]
            kids = [k for k in set(kids) if count(k, open_)[0] >= least and pure(k) >= floor and pairs(k) & pairs(best)]
            if len(kids) < 2 or pure(best) < 0.5 * max(map(pure, kids)):
                if not kids:
                    pool.remove(best)
                    continue
                taken, demoted = max(kids, key=lambda k: (len(pairs(k) & pairs(best)), pure(k), k[1])), f"{best[0]}:{best[1]}"
        gone = pairs(taken)
        out.append((*taken, len(gone), demoted, *count(taken, open_)))
        open_ = {i for i in open_ if of[i] not in gone}
    return out


def test_mixed_cover_against_plain_sets(spark):
    rng = np.random.default_rng(5)
    seen = set()
    for trial in range(3):
        uses, children, i = [], set(), 0
        causes = [("a1", 0.9), ("b1", 0.9), ("b2", 0.8), ("c1", 0.0), ("c2", 0.0), ("d1", 0.7 if trial else 0.0)]
        for n, _ in causes:
            children |= {("as", n[0], n), ("metro", "m" + n[1], n)}
        for pair in range(30):
            for _ in range(6):
                i += 1
                nodes = [causes[k] for k in rng.choice(len(causes), 2, replace=False)]
                hit = bool(rng.random() < max(w for _, w in nodes) * (1.0 if pair % 3 else 0.3))
                for n, _ in nodes:
                    uses += [(i, f"p{pair}", "node", n, hit), (i, f"p{pair}", "as", n[0], hit), (i, f"p{pair}", "metro", "m" + n[1], hit)]
                uses.append((i, f"p{pair}", "edge", "-".join(n for n, _ in nodes), hit))
        want = _plain_cover(uses, children, most_p=0.2, odds=1.05)
        u = spark.createDataFrame(uses, "id long, pair string, gran string, entity string, anomalous boolean").distinct()
        picks, told = tomography.mixed_cover(u, spark.createDataFrame(list(children), "gran string, entity string, node string"), most_p=0.2, least_odds=1.05)
        assert [(p["gran"], p["entity"], p["pairs"], p["demoted_from"], p["support"], p["healthy"]) for p in picks] == want
        seen |= {p["gran"] for p in picks} | {"demoted" for p in picks if p["demoted_from"]}
        rows = {(r["gran"], r["entity"]): r for r in told.collect()}
        assert {k for k, r in rows.items() if r["culprit"]} == {(p["gran"], p["entity"]) for p in picks} and len(rows) > len(picks)
    assert "demoted" in seen or len(seen) > 1


def test_near_seeds_reach_as_far_as_asked(spark):
    rng = np.random.default_rng(6)
    xy = lambda n: list(zip(range(n), rng.uniform(-180, 180, n).tolist(), rng.uniform(-89, 89, n).tolist()))
    a, b = xy(60), xy(60)
    p, q = spark.createDataFrame(a, "i int, lon double, lat double"), spark.createDataFrame(b, "j int, seed_lon double, seed_lat double")
    for km in (300.0, 2500.0):
        near = joins.near_seeds(p, q, km).where(geo.distance(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat")) <= km)
        got = sorted((r["i"], r["j"]) for r in near.collect())
        assert got == sorted((i, j) for i, x, y in a for j, v, w in b if geo.arc_km(geo.unit(x, y), geo.unit(v, w)) <= km)


def test_null_stored_label_stands_for_any(spark, tmp_path):
    from driftline.sources import io

    rows = lambda x, day: spark.createDataFrame(x, "ip long, label string").withColumn(io.DAY, F.to_date(F.lit(day)))
    s = io.Store(spark, f"file://{tmp_path}/s")
    s.write("t", rows([(1, None), (2, "a")], "2024-01-01"))
    new = s.first_writer_wins("t", rows([(1, "x"), (1, None), (2, "b"), (2, "a"), (2, None)], "2024-01-02"), ["ip", "label"], "2024-01-02", any_null=["label"])
    assert sorted((r["ip"], r["label"] or "") for r in new.collect()) == [(2, ""), (2, "b")]


def test_path_local_finds_the_first_bad_hop(spark):
    h = spark.createDataFrame([("p", 1, "a", 1.0), ("p", 2, "b", 9.0), ("p", 3, "c", 9.0), ("q", 1, "a", 9.0)], "pair string, ttl int, node string, rtt double")
    done = spark.createDataFrame([("q",)], "pair string")
    r = tomography.path_local(h, done, F.col("rtt") > 5, F.lit("latency")).collect()
    assert [tuple(x) for x in r] == [("p", "a", "b", "latency")]


def test_nearest_in_time(spark):
    d = spark.createDataFrame([("k", "2024-01-01", 1), ("k", "2024-01-05", 2), ("k", "2023-12-31", 3)], "k string, d string, v int").withColumn("d", F.to_date("d"))
    pick = lambda **a: joins.nearest_in_time(d, ["k"], F.col("d"), F.to_date(F.lit("2024-01-03")), **a).first()["v"]
    assert pick() == 2 and pick(past_first=True) == 1 and pick(prefer=[F.col("v") == 3]) == 3


def test_longest_prefix_v6(spark):
    from driftline.functions import ip

    a = spark.createDataFrame([("2001:db8:1::5",), ("2600::1",)], "ip string").select("ip", ip.parse("ip").alias("p")).select("ip", "p.hi", "p.lo")
    f = spark.createDataFrame([("2001:db8::", 32, 1), ("2001:db8:1::", 48, 2)], "net string, mask int, asn int").select(ip.parse("net").alias("p"), "mask", "asn").select(F.col("p.hi").alias("net_hi"), F.col("p.lo").alias("net_lo"), "mask", "asn")
    r = joins.longest_prefix_v6(a, f).collect()
    assert [(x["ip"], x["asn"]) for x in r] == [("2001:db8:1::5", 2)]


def test_silent_drops_are_counted(spark):
    g = spark.createDataFrame([("a",), ("b",), ("c",)], "pair string")
    c = spark.createDataFrame([("a", 1, 2), ("b", 1, 9)], "pair string, from_asn int, to_asn int")
    meta = spark.createDataFrame([(1, "x"), (2, "y")], "asn int, name string")
    yes, no = publish.resolved(g, c, ["pair"], meta)
    assert [r["pair"] for r in yes.collect()] == ["a"] and [r["pair"] for r in no.collect()] == ["c"]
    assert [r["pair"] for r in publish.silently_dropped(g, c, ["pair"], meta).collect()] == ["b"]


def test_stale_partitions(spark):
    d = spark.createDataFrame([("t", f"2024-01-{i:02d}", 100 if i != 9 else 20) for i in range(1, 20)], "t string, d string, n long").withColumn("day", F.to_date("d")).drop("d")
    assert [str(r["day"]) for r in publish.stale_partitions(d, ["t"]).collect()] == ["2024-01-09"]


def test_merge_null_token(spark):
    down = spark.createDataFrame([(1, "a"), (2, None)], "id int, token string")
    up = spark.createDataFrame([("a", 3.0), ("a", 2.0), (None, 1.0)], "token string, rtt double")
    assert {r["id"]: r["upload_rtt"] for r in traces.merge_up_down(down, up, ["token"], ["rtt"]).collect()} == {1: 2.0, 2: None}


def test_voronoi_owns_its_points(spark):
    seeds = [("c", "a", 2.5, 5.0), ("c", "b", 7.5, 5.0), ("c", "d", 5.0, 9.0)]
    d = spark.createDataFrame(seeds, "country string, metro_id string, seed_lon double, seed_lat double").withColumns({"x0": F.lit(0.0), "x1": F.lit(10.0), "y0": F.lit(0.0), "y1": F.lit(10.0)})
    cells = {r["metro_id"]: np.array([r["ring_lon"], r["ring_lat"]]).T for r in geometry.voronoi(d).collect()}
    assert set(cells) == {"a", "b", "d"}
    rng = np.random.default_rng(2)
    for x, y in rng.uniform(0.5, 9.5, (200, 2)):
        near = min(seeds, key=lambda s: geo.arc_km(geo.unit(s[2], s[3]), geo.unit(x, y)))[1]
        owners = [k for k, ring in cells.items() if geo.inside(geo.densify(ring), np.array([x]), np.array([y]), 1e-6)[0]]
        assert near in owners and len(owners) <= 2


def test_metro_assignment_prefers_covering(spark):
    ring = lambda x0, x1: ([x0, x1, x1, x0, x0], [0.0, 0.0, 2.0, 2.0, 0.0])
    cells = spark.createDataFrame([("a", 1.0, 1.0, *ring(0.0, 2.0)), ("b", 3.0, 1.0, *ring(2.0, 4.0))], "metro_id string, seed_lon double, seed_lat double, ring_lon array<double>, ring_lat array<double>")
    p = spark.createDataFrame([(1.9, 1.0), (4.3, 1.0), (30.0, 1.0), (None, 1.0)], "lon double, lat double")
    got = {r["lon"]: (r["metro_id"], r["covered"]) for r in geometry.assign(p, cells).collect()}
    assert got == {1.9: ("a", True), 4.3: ("b", False)}


@pytest.mark.parametrize("rows,want", [([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "c")], ["a", "a", "b"]), ([(1, "a"), (2, "b")], ["a", "b"])])
def test_first_return_truncates(spark, rows, want):
    d = spark.createDataFrame([(1, t, n) for t, n in rows], "id int, ttl int, own string")
    assert [r["own"] for r in paths.cut_excursions(d, "own", F.lit(False)).orderBy("ttl").collect()] == want
