"""The pipeline's multi-step operators over the harness tables."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo, ip, stats
from driftline.harness.base import DAY, H1, KM, M, N, hops, measurements, nations, one_per_ttl, table
from driftline.harness.relational import _DAILY, _EDGES, _GAPS, _edges
from driftline.operators import geometry, joins, paths
from driftline.plans import legacy, mapping, publish, tomography, traces
from driftline.sources.io import DAY as STORE_DAY
from driftline.sources.io import Store

Q = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


R = lambda c, n=6: F.round(c, n).alias(c)


@query("d1_merge_up_down", f"WITH {M}, u AS (SELECT day, ip, min(rtt) AS upload_rtt, min(loss) AS upload_loss FROM m WHERE site = 'click' GROUP BY ALL) SELECT id, upload_rtt, upload_loss FROM m LEFT JOIN u USING (day, ip) WHERE site <> 'click'")
def d1_merge_up_down(spark, d):
    m = measurements(spark, d)
    return traces.merge_up_down(m.where("site <> 'click'"), m.where("site = 'click'"), ["day", "ip"], ["rtt", "loss"]).select("id", "upload_rtt", "upload_loss")


@query("d2_client_geo", f"WITH {M}, g AS (SELECT o_custkey % 150 AS ip, CAST(o_orderdate AS DATE) AS snap, o_orderpriority AS metro, o_orderkey FROM orders), p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ip ORDER BY abs(date_diff('day', DATE '1996-01-01', snap)), snap DESC, o_orderkey) = 1) SELECT id, metro FROM m JOIN p USING (ip)")
def d2_client_geo(spark, d):
    """Nearest dump of each address (ties: later), joined to the measurements; no metro, no row."""
    g = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("ip"), F.to_date("o_orderdate").alias("snap"), F.format_string("%012d", "o_orderkey").alias("aa"), F.col("o_orderpriority").alias("metro"))
    g = g.select("aa", "ip", "metro", "snap")
    near = joins.nearest_in_time(g, ["ip"], F.col("snap"), F.to_date(F.lit("1996-01-01")))
    return measurements(spark, d).join(near.where("metro is not null").select("ip", "metro"), "ip").select("id", "metro")


@query("d10_attach_traces", "SELECT l_orderkey AS id, count(*) AS hops, bool_or(o_orderstatus = 'F') AS matched FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' OR o_orderkey % 10 = 0 GROUP BY 1")
def d10_attach_traces(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    t = hops(spark, d).join(o, "id")
    groups = o.where("o_orderstatus = 'F'").select("o_orderstatus")
    return traces.attach(t, groups, ["o_orderstatus"], F.col("id") % 10 == 0).groupBy("id").agg(F.count(F.lit(1)).alias("hops"), F.max("matched").alias("matched"))


@query("d11_best_flow", "WITH t AS (SELECT l_orderkey AS id, l_suppkey % 3 AS flow, l_linenumber AS ttl, CASE WHEN l_quantity < 5 THEN '*' ELSE CAST(l_partkey AS VARCHAR) END AS addr, min(l_quantity) AS rtt, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS reaches FROM lineitem GROUP BY ALL), f AS (SELECT id, flow, max(reaches) AS r, count(*) FILTER (addr <> '*') AS n, max(ttl) AS mt FROM t GROUP BY ALL), p AS (SELECT id, flow FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY r DESC, n DESC, mt DESC, flow) = 1) SELECT id, flow, count(*) AS n, sum(rtt) AS rtts FROM t JOIN p USING (id, flow) GROUP BY ALL")
def d11_best_flow(spark, d):
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 3).alias("flow"), F.col("l_linenumber").alias("ttl"),
        F.when(F.col("l_quantity") < 5, "*").otherwise(F.col("l_partkey").cast("string")).alias("addr"), F.col("l_quantity").alias("rtt"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("reaches"),
    )
    return traces.best_flow(t).groupBy("id", "flow").agg(F.count(F.lit(1)).alias("n"), F.sum("rtt").alias("rtts"))


_STAR = "s AS (SELECT l_orderkey AS id, l_linenumber AS ttl, CASE WHEN l_quantity < 5 THEN '*' ELSE lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS addr, l_quantity AS rtt FROM lineitem), c AS (SELECT * FROM s WHERE addr <> '*' QUALIFY row_number() OVER (PARTITION BY id, ttl ORDER BY rtt, addr) = 1), e AS (SELECT id, unnest(generate_series(1, max(ttl))) AS ttl FROM c GROUP BY id), nn AS (SELECT e.id, CAST(e.ttl AS BIGINT) AS ttl, coalesce(addr, '*') AS addr, coalesce(rtt, -1) AS rtt FROM e LEFT JOIN c USING (id, ttl))"


def _normal(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ttl"), F.when(F.col("l_quantity") < 5, "*").otherwise(F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("addr"), F.col("l_quantity").alias("rtt"))
    return traces.normalise(s)


@query("d12_normalise_path", f"WITH {_STAR} SELECT * FROM nn")
def d12_normalise_path(spark, d):
    return _normal(spark, d)


_TRACE = """o AS (SELECT o_orderkey AS id, 'src' || o_custkey AS src, lpad(CAST(o_custkey * 7 % 2000 AS VARCHAR), 9, '0') AS dst, 'site' || (o_custkey % 9) AS site FROM orders),
h AS (SELECT l_orderkey AS id, l_partkey % 3 > 0 AS multipath, CAST(l_linenumber AS BIGINT) AS ttl, CASE WHEN l_quantity < 5 THEN '*' ELSE lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS addr, CASE WHEN l_suppkey % 2 = 0 THEN 'n' || l_suppkey END AS name,
 CASE WHEN l_quantity < 45 THEN l_quantity END AS rtt, CASE WHEN l_suppkey % 4 = 0 THEN lpad(CAST(o_custkey * 7 % 2000 AS VARCHAR), 9, '0') ELSE 'x' END AS link FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
k AS (SELECT * FROM h QUALIFY multipath = max(multipath) OVER (PARTITION BY id)),
v AS (SELECT * FROM k WHERE addr <> '*'), w AS (SELECT id, max(ttl) AS last, bool_or(link = dst) AS led, arg_max(coalesce(rtt, -999), struct_pack(t := ttl, r := -coalesce(rtt, 1e308))) AS tr FROM v JOIN o USING (id) GROUP BY id),
e AS (SELECT id, last, led, nullif(tr, -999) AS trace_rtt, unnest(generate_series(1, last + CAST(led AS INT))) AS ttl FROM w),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id, ttl ORDER BY rtt NULLS LAST, addr) = 1),
z AS (SELECT id, ttl, CASE WHEN ttl = 1 THEN src WHEN led AND ttl = last + 1 THEN dst ELSE coalesce(addr, '*') END AS addr, CASE WHEN ttl = 1 THEN site ELSE coalesce(name, '*') END AS name,
 CASE WHEN ttl = 1 THEN 0 WHEN led AND ttl = last + 1 THEN coalesce(trace_rtt, -1) ELSE coalesce(rtt, -1) END AS rtt, trace_rtt, dst FROM e JOIN o USING (id) LEFT JOIN b USING (id, ttl))"""


@query("d12_normalise_traces", f"WITH {_TRACE} SELECT id, ttl, addr, name, rtt, trace_rtt, arg_max(addr = dst, ttl) OVER (PARTITION BY id) AS reach_dest FROM z")
def d12_normalise_traces(spark, d):
    """Whole paths: the better trace of an id, the server first, the destination added where a link reaches it."""
    o = table(spark, d, "orders")
    dst = F.lpad((F.col("o_custkey") * 7 % 2000).cast("string"), 9, "0")
    ends = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("src"), "o_custkey").alias("src"), dst.alias("dst"), F.concat(F.lit("site"), F.col("o_custkey") % 9).alias("site"))
    h = table(spark, d, "lineitem").join(ends, F.col("l_orderkey") == F.col("id")).select(
        "id", (F.col("l_partkey") % 3 > 0).alias("multipath"), F.col("l_linenumber").alias("ttl"), F.when(F.col("l_quantity") < 5, "*").otherwise(F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("addr"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("n"), "l_suppkey")).alias("name"), F.when(F.col("l_quantity") < 45, F.col("l_quantity")).alias("rtt"), F.when(F.col("l_suppkey") % 4 == 0, F.col("dst")).otherwise("x").alias("link"),
    )
    return traces.normalise_traces(h, ends)


@query("d13_pick_reverse", "SELECT o_custkey AS id, o_orderkey AS key FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def d13_pick_reverse(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "REACHES").otherwise("LOOP").alias("stop_reason"), F.col("o_orderdate").alias("date"))
    return traces.pick_reverse(o).select("id", "key")


@query("d14_city_percentiles", f"WITH {M} SELECT site, count(*) AS n, round(quantile_cont(rtt, 0.01), 6) AS p01, round(quantile_cont(rtt, 0.1), 6) AS p10, round(quantile_cont(rtt, 0.5), 6) AS p50, round(quantile_cont(rtt, 0.9), 6) AS p90 FROM m GROUP BY 1")
def d14_city_percentiles(spark, d):
    q = F.percentile("rtt", F.array(*[F.lit(x) for x in (0.01, 0.1, 0.5, 0.9)])).alias("q")
    return measurements(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"), q).select("site", "n", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p01", "p10", "p50", "p90"))])


def _located(spark, d):
    n = nations(spark, d).select("nk", "rk", "lon", "lat")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("nk"))
    h = one_per_ttl(spark, d).join(s, "node").join(n, "nk")
    known = F.col("node") % 4 > 0
    return h.select("id", "ttl", "node", "rtt", "nk", "rk", F.when(known, F.col("lon")).alias("lon"), F.when(known, F.col("lat")).alias("lat"))


_LOC = f"{H1}, {N}, lo AS (SELECT id, ttl, node, rtt, nk, rk, CASE WHEN node % 4 > 0 THEN lon END AS lon, CASE WHEN node % 4 > 0 THEN lat END AS lat FROM h1 JOIN supplier ON s_suppkey = node JOIN n ON nk = s_nationkey)"


@query("d15_geo_cascade", f"WITH {_LOC} SELECT id, ttl, CASE WHEN node % 9 = 0 THEN NULL WHEN ttl = 1 THEN 0.0 ELSE coalesce(lon, rk * 10.0) END AS lon, coalesce(CASE WHEN node % 3 = 0 THEN 'host' END, CASE WHEN lon IS NOT NULL THEN 'ip' END, 'none') AS place FROM lo")
def d15_geo_cascade(spark, d):
    h = _located(spark, d)
    lon = mapping.coordinates(F.col("node") % 9 == 0, F.col("ttl"), F.lit(0.0), F.col("lon"), F.col("rk") * 10.0)
    place = F.coalesce(F.when(F.col("node") % 3 == 0, "host"), F.when(F.col("lon").isNotNull(), "ip"), F.lit("none"))
    return h.select("id", "ttl", lon.alias("lon"), place.alias("place"))


_DIST = f"""{_LOC}, fl AS (SELECT *, last_value(lon IGNORE NULLS) OVER w AS flon, last_value(lat IGNORE NULLS) OVER w AS flat, first_value(lon IGNORE NULLS) OVER w AS slon, first_value(lat IGNORE NULLS) OVER w AS slat FROM lo WINDOW w AS (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pl AS (SELECT *, lag(flon) OVER v AS plon, lag(flat) OVER v AS plat, lag(rtt) OVER v AS prtt FROM fl WINDOW v AS (PARTITION BY id ORDER BY ttl)),
hk AS (SELECT *, CASE WHEN lon IS NOT NULL THEN {KM.format(a='A', b='B').replace('A.lon', 'plon').replace('A.lat', 'plat').replace('B.lon', 'lon').replace('B.lat', 'lat')} END AS hop_km, {KM.format(a='A', b='B').replace('A.lon', 'flon').replace('A.lat', 'flat').replace('B.lon', 'slon').replace('B.lat', 'slat')} AS back FROM pl),
di AS (SELECT *, sum(coalesce(hop_km, 0)) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path_km FROM hk)"""


@query("d17_distances", f"WITH {_DIST} SELECT id, ttl, round(hop_km, 3) AS hop_km, round(path_km, 3) AS path_km, round((path_km + coalesce(back, 0)) / 200, 4) AS least_rtt, CASE WHEN rtt >= (path_km + coalesce(back, 0)) / 200 THEN 'Above threshold' ELSE 'Below threshold' END AS bound, CASE WHEN rtt + 3 > prtt THEN 'Increasing' ELSE 'Decreasing' END AS trend, CASE WHEN rtt > 30 THEN 'Above baseline' ELSE 'Within baseline' END AS against FROM di")
def d17_distances(spark, d):
    t = mapping.distances(_located(spark, d), F.lit(30))
    return t.select("id", "ttl", R("hop_km", 3), R("path_km", 3), R("least_rtt", 4), "bound", "trend", "against")


def _km(a, b):
    return KM.format(a="A", b="B").replace("A.", a).replace("B.", b)


@query("d17_reverse_distances", f"""WITH {_LOC}, fl AS (SELECT *, last_value(lon IGNORE NULLS) OVER w AS f_lon, last_value(lat IGNORE NULLS) OVER w AS f_lat FROM lo WINDOW w AS (PARTITION BY id ORDER BY ttl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pl AS (SELECT *, lag(f_lon) OVER v AS p_lon, lag(f_lat) OVER v AS p_lat, lag(rtt) OVER (PARTITION BY id ORDER BY ttl) AS prtt FROM fl WINDOW v AS (PARTITION BY id ORDER BY ttl DESC)),
hk AS (SELECT *, coalesce({_km('p_', 'f_')}, 0) AS hop_km, 10.0::DOUBLE AS e_lon, 20.0::DOUBLE AS e_lat, lon AS o_lon, lat AS o_lat FROM pl),
di AS (SELECT *, sum(hop_km) OVER (PARTITION BY id ORDER BY ttl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path_km, {_km('o_', 'e_')} AS to_end FROM hk)
SELECT id, ttl, round(hop_km, 3) AS hop_km, round(path_km, 3) AS path_km, round(to_end, 3) AS to_end_km, CASE WHEN to_end IS NOT NULL THEN CASE WHEN (path_km + to_end) / 200 > rtt THEN 'Above threshold' ELSE 'Below threshold' END END AS bound,
 CASE WHEN rtt > id % 40 THEN 'Above baseline' ELSE 'Within baseline' END AS against, CASE WHEN rtt + 3 > prtt THEN 'Increasing' ELSE 'Stable/Decreasing' END AS trend FROM di""")
def d17_reverse_distances(spark, d):
    h = _located(spark, d).select("id", "ttl", "rtt", "lon", "lat")
    ends = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(10.0).alias("end_lon"), F.lit(20.0).alias("end_lat"), (F.col("o_orderkey") % 40).cast("double").alias("baseline_rtt"))
    t = mapping.reverse_distances(h, ends)
    return t.select("id", "ttl", R("hop_km", 3), R("path_km", 3), R("to_end_km", 3), "bound", "against", "trend")


_ADDR = "(CAST(l_partkey AS BIGINT) * 2654435761) % 4294967296"
_QUAD = "(n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255)"


@query("d15_mapping", f"""WITH h0 AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS ttl, l_quantity AS rtt, l_partkey AS k, {_ADDR} AS n FROM lineitem),
h AS (SELECT *, CASE WHEN rtt < 5 THEN '*' ELSE {_QUAD} END AS addr, (n >= 167772160 AND n < 184549376) OR (n >= 2886729728 AND n < 2887778304) OR (n >= 3232235520 AND n < 3232301056) OR (n >= 1681915904 AND n < 1686110208) AS private FROM h0),
u AS (SELECT DISTINCT addr, n, k FROM h WHERE addr <> '*' AND NOT private),
f AS (SELECT DISTINCT p_size % 25 + 8 AS mask, ((p_partkey * 2654435761) % 4294967296) - (((p_partkey * 2654435761) % 4294967296) % (1::BIGINT << (24 - p_size % 25))) AS network, p_size AS asn FROM part WHERE p_size > 10),
o AS (SELECT addr, asn FROM u JOIN f ON network = n - n % (1::BIGINT << (32 - mask)) QUALIFY row_number() OVER (PARTITION BY addr ORDER BY mask DESC, asn) = 1),
t AS (SELECT u.addr, CASE WHEN k % 7 = 0 THEN 60000 + k % 5 ELSE asn END AS asn, CASE WHEN k % 7 = 0 THEN 'ix' || (k % 3) END AS ixp, CASE WHEN k % 4 > 0 THEN k % 300 - 150.0::DOUBLE END AS lon, CASE WHEN k % 4 > 0 THEN 'm' || (k % 11) END AS metro FROM u LEFT JOIN o USING (addr))
SELECT id, ttl, addr, CAST(asn AS BIGINT) AS asn, ixp, lon, metro FROM h LEFT JOIN t USING (addr)""")
def d15_mapping(spark, d):
    """Longest prefix, exchange members and places of every hop, in one plan."""
    part = table(spark, d, "part")
    number = lambda c: F.pmod(F.col(c).cast("long") * F.lit(2654435761), F.lit(4294967296))
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("ttl"), F.col("l_quantity").alias("rtt"), F.when(F.col("l_quantity") < 5, "*").otherwise(ip.format_v4(number("l_partkey"))).alias("addr"))
    mask = (F.col("p_size") % 25 + 8).cast("int")
    f = part.where("p_size > 10").select(mask.alias("mask"), ip.mask_v4(number("p_partkey"), mask).alias("network"), F.col("p_size").cast("long").alias("asn")).distinct()
    addr, k = ip.format_v4(number("p_partkey")).alias("ip"), F.col("p_partkey").cast("long")
    x = part.where("p_partkey % 7 = 0").select(addr, (k % 5 + 60000).alias("asn"), F.concat(F.lit("ix"), k % 3).alias("name"))
    places = part.where("p_partkey % 4 > 0").select(addr, (k % 300 - 150).cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.concat(F.lit("m"), k % 11).alias("metro"))
    return mapping.annotate(h, f, x, places).select("id", "ttl", "addr", "asn", "ixp", "lon", "metro")


@query("d18_baseline_consistency", f"WITH {H1} SELECT id, ttl, max(rtt > 45) OVER (PARTITION BY id) AS any_, count(CASE WHEN rtt > 45 THEN 1 END) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS so_far FROM h1")
def d18_baseline_consistency(spark, d):
    return mapping.so_far(mapping.any_in_path(one_per_ttl(spark, d), F.col("rtt") > 45), F.col("rtt") > 45).select("id", "ttl", "any_", "so_far")


@query("d16_loop_cleanup", f"WITH {H1}, g AS (SELECT id, ttl, CASE WHEN node % 11 > 0 THEN node % 4 END AS own, part % 3 = 0 AS sus FROM h1), pq AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM g), l AS (SELECT * FROM pq WHERE NOT coalesce(sus AND p = q AND own <> p, false)), k AS (SELECT *, min(ttl) OVER (PARTITION BY id, own) AS first_, last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l), s AS (SELECT *, min(CASE WHEN own IS NOT NULL AND prev <> own AND ttl > first_ THEN ttl END) OVER (PARTITION BY id) AS stop FROM k) SELECT id, ttl, own FROM s WHERE stop IS NULL OR ttl < stop")
def d16_loop_cleanup(spark, d):
    g = one_per_ttl(spark, d).select("id", "ttl", F.when(F.col("node") % 11 > 0, F.col("node") % 4).alias("own"), (F.col("part") % 3 == 0).alias("sus"))
    return paths.cut_excursions(g, "own", F.col("sus")).select("id", "ttl", "own")


@query("d19_reverse_flags", f"WITH {H1}, k AS (SELECT id, ttl, rtt * 3 AS rtt, part % 13 AS kind, last_value(node % 5) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, node % 5 AS owner FROM h1) SELECT id, coalesce(bool_or(kind IN (2, 11, 12) AND owner <> prev), false) AS interdomain, coalesce(max(rtt) FILTER (kind = 4) - max(rtt) FILTER (kind <> 4) > 50, false) AS fishy FROM k GROUP BY 1")
def d19_reverse_flags(spark, d):
    k = one_per_ttl(spark, d).select("id", "ttl", (F.col("rtt") * 3).alias("rtt"), (F.col("part") % 13).alias("kind"), (F.col("node") % 5).alias("owner"))
    return mapping.asymmetric(k, [2, 11, 12])


@query("d20_path_distance", f"WITH {_DIST}, e AS (SELECT id, arg_max(path_km, ttl) AS pk, arg_max(lon, CASE WHEN lon IS NOT NULL THEN ttl END) AS elon, arg_max(lat, CASE WHEN lon IS NOT NULL THEN ttl END) AS elat FROM di GROUP BY id) SELECT o_orderkey AS id, round(coalesce(pk + {KM.format(a='A', b='B').replace('A.lon', 'elon').replace('A.lat', 'elat').replace('B.lon', '5.0').replace('B.lat', '52.0')}, 1000.0), 3) AS km FROM orders LEFT JOIN e ON e.id = o_orderkey")
def d20_path_distance(spark, d):
    straight = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1000.0).alias("km"), F.lit(5.0).alias("client_lon"), F.lit(52.0).alias("client_lat"))
    return mapping.path_distance(mapping.distances(_located(spark, d)), straight).select("id", R("km", 3))


@query("d21_loops", f"WITH {H1}, p AS (SELECT id, list(CASE WHEN node % 17 = 0 THEN -1 ELSE node % 40 END ORDER BY ttl) AS path FROM h1 GROUP BY id) SELECT id, list_contains(path, -1) AS unresponsive, len(path) > len(list_distinct(path)) AND NOT list_contains(path, -1) AS loop FROM p")
def d21_loops(spark, d):
    n = F.when(F.col("node") % 17 == 0, -1).otherwise(F.col("node") % 40)
    p = one_per_ttl(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ttl", n.alias("n")))), lambda s: s.n).alias("path"))
    return p.select("id", paths.loop_flags(F.col("path")).alias("f")).select("id", "f.*")


_BAD = "o AS (SELECT o_orderkey AS id, o_custkey % 40 AS pair, o_orderstatus = 'F' AS bad FROM orders)"
_E2 = f"{H1}, xe AS (SELECT id, ttl, node % 9 AS a, lead(node % 9) OVER (PARTITION BY id ORDER BY ttl) AS b FROM h1 QUALIFY b IS NOT NULL), ee AS (SELECT DISTINCT id, a || '-' || b AS edge FROM xe)"


def _pair_edges(spark, d):
    h = one_per_ttl(spark, d).withColumn("x", F.col("node") % 9)
    e = h.select("id", F.col("x").alias("a"), F.lead("x").over(W.partitionBy("id").orderBy("ttl")).alias("b")).where("b is not null")
    return e.select("id", F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")).alias("edge")).distinct()


def _pairs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).cast("string").alias("pair"), (F.col("o_orderstatus") == "F").alias("bad"))


@query("d23_temporal_fractions", f"WITH {_E2}, {_BAD}, t AS (SELECT count(*) FILTER (bad) AS ta, count(*) FILTER (NOT bad) AS th FROM o), p AS (SELECT edge, count(DISTINCT CASE WHEN bad THEN id END) AS a, count(DISTINCT CASE WHEN NOT bad THEN id END) AS h FROM ee JOIN o USING (id) GROUP BY 1) SELECT edge, a, h, round(a / ta, 6) AS share_a, round(h / th, 6) AS share_h, round((a / ta) / nullif(h / th, 0), 6) AS ratio FROM p, t")
def d23_temporal_fractions(spark, d):
    t = tomography.temporal_fractions(_pair_edges(spark, d), _pairs(spark, d))
    return t.select("edge", "a", "h", R("share_a"), R("share_h"), R("ratio"))


@query("d24_edge_prevalence", f"WITH {_E2}, {_BAD}, z AS (SELECT CAST(pair AS VARCHAR) AS pair, count(DISTINCT CASE WHEN NOT bad THEN id END) AS healthy_n, count(DISTINCT CASE WHEN bad THEN id END) AS dayof_n FROM o GROUP BY 1), p AS (SELECT CAST(pair AS VARCHAR) AS pair, edge, count(DISTINCT CASE WHEN NOT bad THEN id END) AS u, count(DISTINCT CASE WHEN bad THEN id END) AS d FROM ee JOIN o USING (id) GROUP BY ALL) SELECT pair, edge, round(coalesce(u / nullif(healthy_n, 0), 0), 6) AS prev_u, round(coalesce(d / nullif(dayof_n, 0), 0), 6) AS prev_d, healthy_n, dayof_n FROM p JOIN z USING (pair)")
def d24_edge_prevalence(spark, d):
    p = tomography.edge_prevalence(_pair_edges(spark, d), _pairs(spark, d).withColumnRenamed("bad", "dayof"))
    return p.select("pair", "edge", R("prev_u"), R("prev_d"), "healthy_n", "dayof_n")


_PREV = f"""{_E2}, {_BAD}, z AS (SELECT CAST(pair AS VARCHAR) AS pair, count(DISTINCT CASE WHEN NOT bad THEN id END) AS hn, count(DISTINCT CASE WHEN bad THEN id END) AS dn FROM o GROUP BY 1),
p0 AS (SELECT CAST(pair AS VARCHAR) AS pair, edge, count(DISTINCT CASE WHEN NOT bad THEN id END) AS u, count(DISTINCT CASE WHEN bad THEN id END) AS d FROM ee JOIN o USING (id) GROUP BY ALL),
p AS (SELECT pair, edge, coalesce(u / nullif(hn, 0), 0) AS prev_u, coalesce(d / nullif(dn, 0), 0) AS prev_d, hn, dn, CAST(split_part(edge, '-', 1) AS BIGINT) AS k FROM p0 JOIN z USING (pair)),
g AS (SELECT *, greatest(0, prev_d - prev_u) AS g, k % 2 = 0 AS fwd, CASE WHEN prev_u > 0 AND prev_d > 0 THEN k % 7 END AS slower FROM p),
v0 AS (SELECT pair, round(coalesce(sum(g) FILTER (fwd), 0), 9) AS df, round(coalesce(sum(g) FILTER (NOT fwd), 0), 9) AS dr, max(hn) AS hn, max(dn) AS dn,
 (list(edge ORDER BY g DESC, edge DESC) FILTER (g > 0))[1] AS changed, (list(edge ORDER BY slower DESC, edge DESC) FILTER (slower IS NOT NULL))[1] AS slowest FROM g GROUP BY pair),
v AS (SELECT *, CASE WHEN hn < 5 OR dn < 5 THEN 'indeterminate' WHEN greatest(df, dr) >= 1 THEN 'reroute' ELSE 'congestion_in_place' END AS verdict FROM v0)"""


@query("d25_temporal_verdict", f"WITH {_PREV} SELECT pair, verdict, CASE WHEN verdict <> 'indeterminate' THEN CASE WHEN df >= dr THEN 'forward' ELSE 'reverse' END END AS direction, df AS div_f, dr AS div_r, CASE WHEN verdict = 'reroute' THEN changed END AS changed_segment, CASE WHEN verdict = 'congestion_in_place' THEN slowest END AS congested_segment FROM v")
def d25_temporal_verdict(spark, d):
    p = tomography.edge_prevalence(_pair_edges(spark, d), _pairs(spark, d).withColumnRenamed("bad", "dayof"))
    k = F.split("edge", "-")[0].cast("long")
    p = p.withColumns({"direction": F.when(k % 2 == 0, "forward").otherwise("reverse"), "base_rtt": F.lit(10.0), "day_rtt": F.lit(10.0) + k % 7})
    return tomography.verdicts(p, ["pair"])


@query("d26_edge_extraction", f"WITH {H1}, f AS (SELECT id, node % 7 AS x, min(ttl) AS t FROM h1 GROUP BY ALL), e AS (SELECT id, x AS a, lead(x) OVER (PARTITION BY id ORDER BY t) AS b FROM f QUALIFY b IS NOT NULL) SELECT id, a, b, CASE WHEN CAST(a AS VARCHAR) <= CAST(b AS VARCHAR) THEN a || ' - ' || b ELSE b || ' - ' || a END AS canonical, CASE WHEN a = 0 OR b = 0 THEN 'undetermined' WHEN a % 2 = b % 2 THEN 'intradomain' ELSE 'interdomain' END AS kind FROM e")
def d26_edge_extraction(spark, d):
    p = paths.ordered_distinct(one_per_ttl(spark, d).withColumn("x", F.col("node") % 7), "x")
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    kind = F.when((F.col("a") == 0) | (F.col("b") == 0), "undetermined").when(F.col("a") % 2 == F.col("b") % 2, "intradomain").otherwise("interdomain")
    return paths.edges(p).select("id", "a", "b", paths.canonical(a, b, a, b).alias("canonical"), kind.alias("kind"))


def _typed(spark, d):
    return _pairs(spark, d).select("id", "pair", F.when(F.col("bad"), "anomalous").otherwise("healthy").alias("path_type"))


@query("d27_set_cover_first_round", f"WITH {_E2}, {_BAD}, t AS (SELECT count(*) FILTER (bad) AS ta, count(*) FILTER (NOT bad) AS th FROM o), c AS (SELECT edge, count(DISTINCT CASE WHEN bad THEN id END) AS a, count(DISTINCT CASE WHEN NOT bad THEN id END) AS h, count(DISTINCT CASE WHEN bad THEN pair END) AS support FROM ee JOIN o USING (id) GROUP BY 1) SELECT edge, a, h, support, round(a * (th - h) / ((ta - a) * h), 6) AS odds FROM c, t")
def d27_set_cover_first_round(spark, d):
    m = _typed(spark, d)
    s = tomography.edge_stats(tomography.pair_edges(_pair_edges(spark, d), m), tomography.totals(m))
    return s.select("edge", "a", "h", "support", R("odds"))


@query("d27_set_cover")
def d27_set_cover(spark, d):
    """All rounds; gates are loosened, as the harness tables hold no real culprit."""
    _, explained = tomography.greedy_cover(_pair_edges(spark, d), _typed(spark, d), most_p=0.6, least_odds=0.9)
    return explained


_LOCAL = """{n} AS (SELECT pair, min(struct_pack(t := ttl, x := node)) FILTER (rtt > {most}) AS f FROM hp WHERE {w} GROUP BY pair),
{n}g AS (SELECT pair, any_value(f.x) AS node, max(struct_pack(t := ttl, x := hp.node)) FILTER (rtt <= {most} AND struct_pack(t := ttl, x := hp.node) < f) AS good FROM hp JOIN {n} USING (pair) WHERE {w} AND f IS NOT NULL GROUP BY pair)"""


@query("d28_path_local", f"WITH {H1}, {_BAD}, hp AS (SELECT CAST(pair AS VARCHAR) AS pair, ttl, node, rtt, id FROM h1 JOIN o USING (id)), {_LOCAL.format(n='a', most=49.8, w='id % 2 = 0')}, {_LOCAL.format(n='b', most=49, w='id % 2 = 1')} SELECT coalesce(ag.pair, bg.pair) AS pair, CASE WHEN ag.pair IS NOT NULL THEN ag.good.x ELSE bg.good.x END AS good, coalesce(ag.node, bg.node) AS node, 'latency rises' AS reason, CASE WHEN ag.pair IS NOT NULL THEN 'forward' ELSE 'reverse' END AS direction FROM ag FULL JOIN bg ON ag.pair = bg.pair")
def d28_path_local(spark, d):
    """The forward path tells, else the reverse one."""
    h = one_per_ttl(spark, d).join(_pairs(spark, d), "id").select("id", "pair", "ttl", "node", "rtt")
    none = spark.range(0).select(F.col("id").cast("string").alias("pair"))
    reason = stats.flag_reason(F.array(F.lit("rtt")), [("loss", "loss rises"), ("rtt", "latency rises")])
    return tomography.path_local_either(h.where("id % 2 = 0").drop("id"), h.where("id % 2 = 1").drop("id"), none, F.col("rtt") > 49.8, F.col("rtt") > 49, reason)


@query("d29_hyperedges", f"WITH {_E2}, g AS (SELECT DISTINCT 'a' AS gran, split_part(edge, '-', 1) AS node, edge FROM ee UNION SELECT DISTINCT 'b', split_part(edge, '-', 2), edge FROM ee) SELECT gran, node, count(*) AS total, count(*) FILTER (edge LIKE '%3') AS culprit, round(count(*) FILTER (edge LIKE '%3') / count(*), 6) AS share FROM g GROUP BY ALL")
def d29_hyperedges(spark, d):
    e = _pair_edges(spark, d).select("edge").distinct()
    side = lambda g, i: e.select(F.lit(g).alias("gran"), F.split("edge", "-")[i].alias("node"), "edge")
    return tomography.hyperedges(side("a", 0).unionByName(side("b", 1)), e.where("edge like '%3'")).withColumn("share", F.round("share", 6))


def _uses(spark, d):
    e = _pair_edges(spark, d).join(_pairs(spark, d), "id")
    part = lambda g, c: e.select("id", "pair", F.lit(g).alias("gran"), c.alias("entity"), F.col("bad").alias("anomalous"))
    node = F.split("edge", "-")[0]
    return part("edge", F.col("edge")).unionByName(part("node", node)).unionByName(part("as", F.concat(F.lit("as"), node.cast("long") % 5))).distinct()


def _mixed(spark, d):
    """Gates are loosened, as the harness tables hold no real culprit."""
    u = _uses(spark, d)
    nodes = u.where("gran = 'node'").select(F.lit("as").alias("gran"), F.concat(F.lit("as"), F.col("entity").cast("long") % 5).alias("entity"), F.col("entity").alias("node")).distinct()
    return tomography.mixed_cover(u, nodes, most_p=0.6, least_odds=0.9, most_steps=12)


@query("d30_mixed_cover")
def d30_mixed_cover(spark, d):
    keep = ["gran", "entity", "pairs", "step", "demoted_from", "support", "healthy", "p", "odds", "explained", "share"]
    rows = [tuple(float(x[k]) if k in ("p", "odds", "share") else x[k] for k in keep) for x in _mixed(spark, d)[0]]
    return spark.createDataFrame(rows, "gran string, entity string, pairs long, step long, demoted_from string, support long, healthy long, p double, odds double, explained long, share double")


_USES = f"""{_E2}, {_BAD}, x AS (SELECT id, CAST(pair AS VARCHAR) AS pair, edge, split_part(edge, '-', 1) AS node, bad FROM ee JOIN o USING (id)),
us AS (SELECT id, pair, 'edge' AS gran, edge AS entity, bad FROM x UNION SELECT id, pair, 'node', node, bad FROM x UNION SELECT id, pair, 'as', 'as' || CAST(node AS BIGINT) % 5, bad FROM x)"""


@query("d30_entity_statistics", f"WITH {_USES}, t AS (SELECT count(DISTINCT CASE WHEN bad THEN id END) AS ta, count(DISTINCT CASE WHEN NOT bad THEN id END) AS th FROM us), c AS (SELECT gran, entity, count(DISTINCT CASE WHEN bad THEN id END) AS a, count(DISTINCT CASE WHEN NOT bad THEN id END) AS h FROM us GROUP BY ALL) SELECT gran, entity, a, h, round(a * (th - h) / nullif((ta - a) * h, 0), 6) AS odds, round((a / ta) / nullif(h / th, 0), 6) AS ratio FROM c, t WHERE a >= 2 AND h > 0 AND a < ta")
def d30_entity_statistics(spark, d):
    """Statistics of all entities, winners or not."""
    whole = tomography.mixed_cover(_uses(spark, d), most_steps=0)[1]
    return whole.where("h > 0 and odds < double('infinity')").select("gran", "entity", "a", "h", R("odds"), R("ratio"))


@query("d31_cumulative", f"WITH {_E2}, {_BAD}, c AS (SELECT edge AS entity, count(DISTINCT CASE WHEN bad THEN pair END) AS pairs FROM ee JOIN o USING (id) GROUP BY 1), r AS (SELECT entity, pairs, row_number() OVER (ORDER BY pairs DESC, entity) AS step FROM c) SELECT step, entity, pairs, sum(pairs) OVER (ORDER BY step, entity ROWS UNBOUNDED PRECEDING)::BIGINT AS explained FROM r WHERE step <= 50")
def d31_cumulative(spark, d):
    """The 50 edges of most support in the first round, as picks."""
    m = _typed(spark, d)
    s = tomography.edge_stats(tomography.pair_edges(_pair_edges(spark, d), m), tomography.totals(m))
    top = s.select(F.col("edge").alias("entity"), F.col("support").alias("pairs")).orderBy(F.desc("pairs"), "entity").limit(50)
    return tomography.cumulative(top.withColumn("step", F.row_number().over(W.orderBy(F.desc("pairs"), "entity")).cast("long")))


@query("d32_public_groups", f"WITH {M} SELECT site, CAST(asn AS BIGINT) AS asn, count(*) FILTER (day = DATE '{DAY}') AS n_dayof, count(*) FILTER (day <> DATE '{DAY}') AS n_baseline, round(avg(rtt) FILTER (day = DATE '{DAY}'), 6) AS rtt_day, round(avg(rtt) FILTER (day <> DATE '{DAY}'), 6) AS rtt_base, max(rtt) FILTER (day = DATE '{DAY}') AS rtt_most FROM m WHERE day BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' GROUP BY ALL HAVING count(*) FILTER (day = DATE '{DAY}') >= 5")
def d32_public_groups(spark, d):
    day = F.to_date(F.lit(DAY))
    m = measurements(spark, d).where(F.col("day").between(F.date_sub(day, 7), day)).withColumn("asn", F.col("asn").cast("long"))
    return publish.public_groups(m, ["site", "asn"], day, 5).select("site", "asn", "n_dayof", "n_baseline", R("rtt_day"), R("rtt_base"), "rtt_most")


@query("d32_resolved", "WITH c AS (SELECT o_custkey % 50 AS pair, min(o_orderkey % 30) AS f, min(o_orderkey % 25) AS t FROM orders GROUP BY 1), g AS (SELECT DISTINCT c_custkey % 60 AS pair FROM customer) SELECT pair, a.n_name || '>' || b.n_name AS edge FROM g JOIN c USING (pair) JOIN nation a ON a.n_nationkey = f JOIN nation b ON b.n_nationkey = t UNION ALL SELECT pair, 'unresolved' FROM g WHERE pair NOT IN (SELECT pair FROM c)")
def d32_resolved(spark, d):
    """Pairs 50 to 59 have no order and stay unresolved."""
    c = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("pair")).agg(F.min(F.col("o_orderkey") % 30).alias("from_asn"), F.min(F.col("o_orderkey") % 25).alias("to_asn"))
    g = table(spark, d, "customer").select((F.col("c_custkey") % 60).alias("pair")).distinct()
    yes, no = publish.resolved(g, c, ["pair"], table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("asn"), F.col("n_name").alias("name")))
    return yes.select("pair", F.concat("from_name", F.lit(">"), "to_name").alias("edge")).unionByName(no.select("pair", F.lit("unresolved").alias("edge")))


@query("d32_source_override", f"WITH {M}, e AS (SELECT ip, site, max(loss) > 0.05 AS bad FROM m GROUP BY ALL), s AS (SELECT ip, count(*) >= 2 AND count(*) FILTER (bad) >= 0.75 * count(*) AS src FROM e GROUP BY 1) SELECT ip, site, CASE WHEN src THEN 'source' ELSE 'path' END AS location FROM e JOIN s USING (ip)")
def d32_source_override(spark, d):
    e = measurements(spark, d).groupBy("ip", "site").agg((F.max("loss") > 0.05).alias("bad")).withColumn("location", F.lit("path"))
    return publish.source_override(e, "ip", "site", F.col("bad")).select("ip", "site", "location")


_VIEW = f"{H1}, c AS (SELECT id, ttl, node, rtt, CASE WHEN ttl % 2 = 0 THEN rtt ELSE rtt * 2 END AS cum FROM h1), st AS (SELECT *, abs(coalesce(cum - lag(cum) OVER (PARTITION BY id ORDER BY ttl), cum)) AS step FROM c)"


@query("d33_event_view", f"WITH {_VIEW} SELECT id, round(sum(step), 6) AS path_km, count(*) AS n_hops, count(DISTINCT node) AS n_nodes, round(sum(step) / 100.0, 6) AS detour FROM st GROUP BY 1")
def d33_event_view(spark, d):
    h = one_per_ttl(spark, d).withColumn("cum_km", F.when(F.col("ttl") % 2 == 0, F.col("rtt")).otherwise(F.col("rtt") * 2))
    v = publish.hop_view(h)
    ev = v.select("id", F.lit(1).alias("asn"), F.lit("M").alias("client_metro"), F.lit("s").alias("site"), F.lit(1.0).alias("rtt_base"), F.lit(2.0).alias("rtt_day"))
    e = publish.event_view(ev, v, F.lit(100.0))
    return e.join(v.select("id", "n_hops", "n_nodes"), "id").select("id", F.round("server_to_client_path.path_km", 6).alias("path_km"), "n_hops", "n_nodes", F.round("server_to_client_path.detour", 6).alias("detour"))


@query("d34_candidate_addresses", f"WITH {M}, k AS (SELECT DISTINCT '192.0.2.' || ip AS ip FROM m WHERE day >= DATE '{DAY}' - 2 AND ip % 3 > 0) SELECT DISTINCT CASE WHEN ip % 7 = 0 THEN '10.0.0.' ELSE '192.0.2.' END || ip AS ip FROM m WHERE ip % 7 > 0 AND '192.0.2.' || ip NOT IN (SELECT ip FROM k)")
def d34_candidate_addresses(spark, d):
    m = measurements(spark, d)
    rows = m.select(F.concat(F.when(F.col("ip") % 7 == 0, "10.0.0.").otherwise("192.0.2."), F.col("ip").cast("string")).alias("ip"))
    known = m.select(F.concat(F.lit("192.0.2."), F.col("ip").cast("string")).alias("ip"), "day", F.when(F.col("ip") % 3 > 0, F.lit(1.0)).alias("lat"), F.lit(1.0).alias("lon"))
    day = F.date_add(F.to_date(F.lit(DAY)), 8)
    return mapping.candidate_addresses(rows, known, F.date_add(day, 20), 30)


@query("d35_geo_label", "SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN c_mktsegment || '-' || c_nationkey ELSE c_mktsegment || '-R' || (c_nationkey % 3) || '-' || c_nationkey END AS label FROM customer")
def d35_geo_label(spark, d):
    city = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_mktsegment"))
    region = F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit("R"), F.col("c_nationkey") % 3))
    return table(spark, d, "customer").select("c_custkey", mapping.geo_label(city, region, F.col("c_nationkey").cast("string")).alias("label"))


@query("d36_stale_partitions", f"WITH {_DAILY}, j AS (SELECT a.site, a.day, a.n, quantile_cont(b.n, 0.5) AS median FROM v a JOIN v b ON a.site = b.site AND b.day BETWEEN a.day - 7 AND a.day + 7 AND b.day <> a.day GROUP BY ALL) SELECT site, CAST(day AS VARCHAR) AS day, n, round(median, 6) AS median FROM j WHERE n / median < 0.9")
def d36_stale_partitions(spark, d):
    v = measurements(spark, d).groupBy("site", "day").agg(F.count(F.lit(1)).alias("n"))
    return publish.stale_partitions(v, ["site"], 0.9).select("site", F.col("day").cast("string").alias("day"), "n", R("median"))


@query("d36_missing_days", f"WITH {M} SELECT CAST(g AS VARCHAR)[:10] AS day FROM generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY) t(g) WHERE CAST(g AS DATE) NOT IN (SELECT day FROM m)")
def d36_missing_days(spark, d):
    return publish.missing_days(measurements(spark, d), "2024-01-01", "2024-02-10").select(F.col("day").cast("string").alias("day"))


@query("d36_unattributed", f"WITH {M} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM m WHERE site = 'click' GROUP BY 1 HAVING count(CASE WHEN asn = 3 AND extract(day FROM day) % 5 > 0 THEN 1 END) = 0")
def d36_unattributed(spark, d):
    e = measurements(spark, d).where("site = 'click'").withColumn("culprit", F.when((F.col("asn") == 3) & (F.dayofmonth("day") % 5 > 0), 1))
    return publish.unattributed(e).select(F.col("day").cast("string").alias("day"), "n")


@query("d36_contract", "SELECT 'unknown_label' AS name, count(*) AS n FROM customer WHERE c_nationkey >= 20 UNION ALL SELECT 'empty_label', 0 UNION ALL SELECT 'repeated_event', 0")
def d36_contract(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("label"))
    return publish.contract_violations(c, table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("label")))


@query("d22_source_metro", f"WITH {N}, e AS (SELECT c_custkey AS id, lon, lat, 'New-' || n_name || '-S-' || rk AS m FROM customer JOIN n ON nk = c_nationkey WHERE nk % 4 > 0) SELECT c_custkey AS id, m AS src_metro, 'New-' || substr(m, 5, length(m) - 8) AS src_metro_city FROM customer LEFT JOIN e ON e.id = c_custkey")
def d22_source_metro(spark, d):
    n = nations(spark, d)
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nk")).join(n.select("nk", "lon", "lat"), "nk")
    r = n.where("nk % 4 > 0").select("lon", "lat", F.concat(F.lit("New-"), "n_name", F.lit("-S-"), F.col("rk").cast("string")).alias("metro_id"))
    return legacy.source_metro(e, r).select("id", "src_metro", "src_metro_city")


@query("d38_legacy_loss", f"WITH {M} SELECT site, CAST(asn AS BIGINT) AS asn, CAST(quantile_cont(loss, 0.5) > 0.05 AS INT) AS flag FROM m GROUP BY ALL")
def d38_legacy_loss(spark, d):
    m = measurements(spark, d).groupBy("site", F.col("asn").cast("long").alias("asn")).agg(F.percentile("loss", F.lit(0.5)).alias("l"))
    return m.select("site", "asn", legacy.legacy_loss_flag(F.col("l")).alias("flag"))


@query("d38_legacy_best_node", f"WITH {H1}, p AS (SELECT id % 50 AS pair, ttl, node % 20 AS node FROM h1) SELECT pair, ttl, node FROM (SELECT pair, ttl, node, count(*) AS n FROM p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pair, ttl ORDER BY n DESC, node) = 1")
def d38_legacy_best_node(spark, d):
    return legacy.legacy_best_node(one_per_ttl(spark, d).select((F.col("id") % 50).alias("pair"), "ttl", (F.col("node") % 20).alias("node")))


_PREV = f"{_E2}, {_BAD}, z AS (SELECT CAST(pair AS VARCHAR) AS pair, count(DISTINCT CASE WHEN NOT bad THEN id END) AS healthy_n, count(DISTINCT CASE WHEN bad THEN id END) AS dayof_n FROM o GROUP BY 1), pp AS (SELECT CAST(pair AS VARCHAR) AS pair, edge, count(DISTINCT CASE WHEN NOT bad THEN id END) AS u, count(DISTINCT CASE WHEN bad THEN id END) AS d FROM ee JOIN o USING (id) GROUP BY ALL), pv AS (SELECT pair, edge, coalesce(u / nullif(healthy_n, 0), 0) AS prev_u, coalesce(d / nullif(dayof_n, 0), 0) AS prev_d, healthy_n, dayof_n FROM pp JOIN z USING (pair))"


def _prevalence(spark, d):
    return tomography.edge_prevalence(_pair_edges(spark, d), _pairs(spark, d).withColumnRenamed("bad", "dayof"))


@query("udf_label_edges", f"WITH {_PREV} SELECT pair, edge, CASE WHEN prev_d - prev_u >= 0.02 THEN 'diverted' WHEN prev_d - prev_u <= -0.02 THEN 'abandoned' ELSE 'stable' END AS label FROM pv")
def udf_label_edges(spark, d):
    return _prevalence(spark, d).select("pair", "edge", stats.edge_label(F.col("prev_u"), F.col("prev_d"), 0.02).alias("label"))


@query("udf_divergence", f"WITH {_PREV} SELECT pair, round(sum(greatest(0, prev_d - prev_u)), 6) AS divergence FROM pv GROUP BY 1")
def udf_divergence(spark, d):
    gain = F.greatest(F.lit(0.0), F.col("prev_d") - F.col("prev_u"))
    return _prevalence(spark, d).groupBy("pair").agg(F.round(F.sum(gain), 6).alias("divergence"))


@query("udf_classify", f"WITH {_PREV}, g AS (SELECT pair, sum(greatest(0, prev_d - prev_u)) AS div, max(healthy_n) AS h, max(dayof_n) AS n FROM pv GROUP BY 1) SELECT pair, CASE WHEN h < 5 OR n < 5 THEN 'indeterminate' WHEN div >= 0.3 THEN 'reroute' ELSE 'congestion_in_place' END AS verdict, CASE WHEN h >= 5 AND n >= 5 THEN CASE WHEN div >= 0.25 THEN 'forward' ELSE 'reverse' END END AS direction FROM g")
def udf_classify(spark, d):
    gain = F.sum(F.greatest(F.lit(0.0), F.col("prev_d") - F.col("prev_u")))
    g = _prevalence(spark, d).groupBy("pair").agg(gain.alias("f"), F.max("healthy_n").alias("h"), F.max("dayof_n").alias("n"))
    what, way = stats.verdict(F.col("f"), F.lit(0.25), F.col("h"), F.col("n"), 0.3)
    return g.select("pair", what.alias("verdict"), way.alias("direction"))


@query("udf_confidence_tier", f"WITH {M} SELECT id, CASE WHEN asn = 0 THEN 'path_local' WHEN loss <= 0.01 AND ip % 7 >= 3 AND rtt >= 2 THEN 'strong' ELSE 'weak' END AS tier FROM m")
def udf_confidence_tier(spark, d):
    return measurements(spark, d).select("id", stats.confidence_tier(F.col("asn") == 0, F.col("loss"), F.col("ip") % 7, F.col("rtt")).alias("tier"))


@query("udf_flag_reason", f"WITH {M} SELECT id, CASE WHEN loss > 0.05 THEN 'loss rises' WHEN rtt > 50 THEN 'latency rises' END AS reason FROM m")
def udf_flag_reason(spark, d):
    flags = F.filter(F.array(F.when(F.col("rtt") > 50, "rtt"), F.when(F.col("loss") > 0.05, "loss")), lambda x: x.isNotNull())
    return measurements(spark, d).select("id", stats.flag_reason(flags, [("loss", "loss rises"), ("rtt", "latency rises")]).alias("reason"))


# --- sources and sinks ---


@query("scan_nested", f"WITH {H1} SELECT id, sum(rtt) AS rtts, count(*) AS n FROM h1 GROUP BY 1")
def scan_nested(spark, d):
    """scan_scamper1/2 and scan_revtr: nested traces, only the fields asked for are kept."""
    s = F.array_sort(F.collect_list(F.struct("ttl", "node", F.array(F.struct("rtt")).alias("replies"))))
    nested = one_per_ttl(spark, d).groupBy("id").agg(s.alias("nodes"))
    flat = nested.select("id", F.explode("nodes").alias("x")).select("id", F.explode("x.replies").alias("r"))
    return flat.groupBy("id").agg(F.sum("r.rtt").alias("rtts"), F.count(F.lit(1)).alias("n"))


@query("scan_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def scan_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT").getField("k").alias("k"))


def _store(spark):
    """An empty store beside the checkpoints, which driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="driftline-")
    return Store(spark, f"{named.rstrip('/')}/store-{uuid.uuid4().hex}")


def _days(df, col):
    return df.withColumn(STORE_DAY, col)


@query("sink_merge_update", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 2 = 0 THEN n_name ELSE c_mktsegment END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sink_merge_update(spark, d):
    """One of two partitions of a stored table takes the values of the rows that it matches."""
    s = _store(spark)
    day = F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("date")
    s.write("customer", _days(table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("v")), day))
    new = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("v"))
    s.merge("customer", "2024-01-02", new, ["c_nationkey"], "v")
    return s.read("customer").select("c_custkey", "v")


@query("sink_first_writer_wins", f"WITH {M} SELECT DISTINCT ip, site FROM m WHERE day = DATE '{DAY}' AND (ip, site) NOT IN (SELECT (ip, site) FROM m WHERE day BETWEEN DATE '{DAY}' - 3 AND DATE '{DAY}' - 1 AND ip % 9 > 0) AND ip NOT IN (SELECT ip FROM m WHERE day BETWEEN DATE '{DAY}' - 3 AND DATE '{DAY}' - 1 AND ip % 9 = 0)")
def sink_first_writer_wins(spark, d):
    """The day's rows whose key no earlier partition has; a stored site that is null stands for any."""
    s, m, day = _store(spark), measurements(spark, d), F.to_date(F.lit(DAY))
    old = m.where(F.col("day").between(F.date_sub(day, 3), F.date_sub(day, 1))).select("ip", F.when(F.col("ip") % 9 > 0, F.col("site")).alias("site"), F.col("day").alias(STORE_DAY))
    s.write("events", old)
    s.first_writer_wins("events", m.where(F.col("day") == day).select("ip", "site", F.col("day").alias(STORE_DAY)), ["ip", "site"], DAY, 3, any_null=["site"])
    return s.day("events", DAY).select("ip", "site")


@query("sink_update_provenance", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN 'city' END, CASE WHEN c_acctbal <= 0 AND c_custkey % 3 > 0 THEN 'metro' END) AS granularity FROM customer")
def sink_update_provenance(spark, d):
    """Only rows without a granularity, in one partition, are updated."""
    s = _store(spark)
    day = F.when(F.col("c_custkey") % 3 > 0, F.lit("2024-01-02")).otherwise("2024-01-01").cast("date")
    s.write("customer", _days(table(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 4 > 0, "city").alias("granularity")), day))
    s.update_where("customer", "2024-01-02", "granularity", F.lit("metro"), F.col("granularity").isNull() & (F.col("c_acctbal") <= 0))
    return s.read("customer").select("c_custkey", "granularity")


@query("sink_insert_partition", f"WITH {M} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM m WHERE day BETWEEN DATE '{DAY}' - 3 AND DATE '{DAY}' AND day <> DATE '{DAY}' - 2 GROUP BY 1")
def sink_insert_partition(spark, d):
    """sink_insert_partition, sink_delete_insert, sink_copy_partitions, sink_delete_dates: days are written
    twice, copied to another root, and one is dropped there."""
    a, b, day = _store(spark), _store(spark), F.to_date(F.lit(DAY))
    m = measurements(spark, d).where(F.col("day").between(F.date_sub(day, 5), day)).select("id", F.col("day").alias(STORE_DAY))
    a.write("m", m)
    a.write("m", m.where(F.col(STORE_DAY) == day))
    first = (dt.date.fromisoformat(DAY) - dt.timedelta(3)).isoformat()
    b.copy_days("m", a, first, DAY)
    b.delete_days(["m"], [(dt.date.fromisoformat(DAY) - dt.timedelta(2)).isoformat()])
    return b.read("m").groupBy(F.col(STORE_DAY).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_info_schema", f"WITH {M} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM m GROUP BY 1")
def scan_info_schema(spark, d):
    """Partitions and their rows, from the files' footers."""
    s = _store(spark)
    s.write("m", measurements(spark, d).select("id", F.col("day").alias(STORE_DAY)))
    return s.partition_rows("m").select("day", "n")


# --- geometry ---


@query("geo_distance", f"WITH {N} SELECT a.nk AS a, b.nk AS b, round({KM.format(a='a', b='b')}, 4) AS km FROM n a, n b WHERE a.rk = b.rk")
def geo_distance(spark, d):
    n = nations(spark, d)
    o = n.select(F.col("nk").alias("b"), "rk", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return n.join(o, "rk").select(F.col("nk").alias("a"), "b", F.round(geo.distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("km"))


@query("geo_metro_name", "SELECT n_nationkey::BIGINT AS k, regexp_replace(trim('New  ' || n_name || '-' || coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'ST' END, CASE WHEN n_nationkey % 3 = 0 THEN 'I2' END, 'NA') || '-C' || n_regionkey), '\\s+', ' ', 'g') AS metro FROM nation")
def geo_metro_name(spark, d):
    st, iso = F.when(F.col("n_nationkey") % 2 == 0, "ST"), F.when(F.col("n_nationkey") % 3 == 0, "I2")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), geo.metro_name(F.concat(F.lit("New  "), "n_name"), st, iso, F.concat(F.lit("C"), "n_regionkey")).alias("metro"))


def _points(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point"), (F.col("c_custkey") * 13 % 340 - 170.0).alias("lon"), (F.col("c_custkey") * 7 % 160 - 80.0).alias("lat"), (F.col("c_nationkey") % 7).cast("string").alias("country"))


_P = "p AS (SELECT c_custkey AS point, c_custkey * 13 % 340 - 170.0::DOUBLE AS lon, c_custkey * 7 % 160 - 80.0::DOUBLE AS lat, CAST(c_nationkey % 7 AS VARCHAR) AS country FROM customer)"


def _seeds(spark, d):
    return nations(spark, d).select(F.col("n_name").alias("metro_id"), F.col("rk").cast("string").alias("country"), F.col("lon").alias("seed_lon"), F.col("lat").alias("seed_lat"), F.lit(None).cast("string").alias("state"))


@query("geo_metro_fallback", f"WITH {N}, {_P}, dp AS (SELECT DISTINCT lon, lat, country FROM p), j AS (SELECT dp.*, n_name, {KM.format(a='dp', b='n')} AS km FROM dp LEFT JOIN n ON CAST(rk AS VARCHAR) = country), b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lon, lat, country ORDER BY km, n_name) = 1) SELECT lon, lat, country, n_name AS metro_id, round(km, 4) AS km, CASE WHEN n_name IS NULL THEN 'no_country_cells' WHEN km > 100 THEN 'country_nearest_far' ELSE 'country_nearest' END AS method FROM b")
def geo_metro_fallback(spark, d):
    """join_spatial_country, geo_distinct_coords and geo_lookup_simple by seeds."""
    return joins.metro_of_country(_points(spark, d), _seeds(spark, d).drop("state")).withColumn("km", F.round("km", 4))


_SEEDS = "sd AS (SELECT n_name AS metro_id, CAST(rk AS VARCHAR) AS country, 's' || (length(n_name) % 2) AS state, lon, lat FROM n)"


@query("geo_lookup_tiered", f"WITH {N}, {_P}, {_SEEDS}, q AS (SELECT *, CASE WHEN point % 2 = 0 THEN 's0' END AS state FROM p), k AS (SELECT q.point, sd.metro_id, sd.state = q.state AS same, {KM.format(a='q', b='sd')} AS km FROM q JOIN sd ON sd.country = q.country), bs AS (SELECT point, metro_id FROM k WHERE same QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, metro_id) = 1), bc AS (SELECT point, metro_id, km FROM k QUALIFY row_number() OVER (PARTITION BY point ORDER BY km, metro_id) = 1) SELECT q.*, coalesce(bs.metro_id, bc.metro_id) AS metro_id, CASE WHEN bs.metro_id IS NOT NULL THEN 'state_nearest' WHEN bc.km > 100 THEN 'country_nearest_far' WHEN bc.km IS NOT NULL THEN 'country_nearest' ELSE 'no_country_cells' END AS method FROM q LEFT JOIN bs USING (point) LEFT JOIN bc USING (point)")
def geo_lookup_tiered(spark, d):
    p = _points(spark, d).withColumn("state", F.when(F.col("point") % 2 == 0, "s0"))
    s = _seeds(spark, d).withColumn("state", F.concat(F.lit("s"), F.length("metro_id") % 2))
    return geometry.tiered(p, s)


def _boxes(spark, d):
    x, y = F.col("seed_lon"), F.col("seed_lat")
    c = _seeds(spark, d).withColumns({"x0": x - 4.0, "x1": x + 4.0, "y0": F.greatest(y - 4.0, F.lit(-89.0)), "y1": F.least(y + 4.0, F.lit(89.0))})
    return c.withColumns({"ring_lon": F.array("x0", "x1", "x1", "x0", "x0"), "ring_lat": F.array("y0", "y0", "y1", "y1", "y0")})


@query("geo_metro_assign")
def geo_metro_assign(spark, d):
    """join_spatial_within, join_spatial_covers, geo_covers, geo_dwithin."""
    return geometry.assign(_points(spark, d), _boxes(spark, d).drop("country", "state"))


@query("geo_voronoi")
def geo_voronoi(spark, d):
    return geometry.voronoi(_boxes(spark, d).drop("ring_lon", "ring_lat"))


@query("geo_population", "SELECT n_name AS metro_id, coalesce(CAST(round(sum(c_acctbal) FILTER (c_acctbal > 0)) AS BIGINT), 0) AS population FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 4 > 0 GROUP BY 1")
def geo_population(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("metro_id"))
    g = table(spark, d, "customer").where("c_nationkey % 4 > 0").join(n, "c_nationkey").select("metro_id", F.col("c_acctbal").alias("population"))
    return geometry.population(g, n)


@query("geo_seed_checks", f"WITH {N} SELECT 'near' AS kind, a.n_name AS metro_id FROM n a JOIN n b ON a.rk % 2 = b.rk % 2 AND a.n_name < b.n_name AND {KM.format(a='a', b='b')} <= 2500 GROUP BY 2 UNION ALL SELECT 'invalid', n_name FROM n WHERE nk = 24 UNION ALL SELECT 'repeated', n_name FROM n WHERE nk = 3")
def geo_seed_checks(spark, d):
    """Seeds of two made countries; one has no coordinates, one comes twice (in another country)."""
    s = _seeds(spark, d).withColumn("country", F.col("country").cast("int") % 2)
    three = nations(spark, d).where("nk = 3").select(F.col("n_name").alias("metro_id"))
    n24 = nations(spark, d).where("nk = 24").select(F.col("n_name").alias("metro_id"))
    again = three.select("metro_id", F.lit(9).alias("country"), F.lit(0.0).alias("seed_lon"), F.lit(0.0).alias("seed_lat"))
    lost = n24.select("metro_id", F.lit(8).alias("country"), F.lit(None).cast("double").alias("seed_lon"), F.lit(0.0).alias("seed_lat"))
    every = s.select("metro_id", "country", "seed_lon", "seed_lat").unionByName(again).unionByName(lost)
    return _but(geometry.seed_problems(every, 2500.0), n24)


def _but(problems, twice_by_design):
    """The seed without coordinates has its id twice too; that is not what is asked here."""
    both = twice_by_design.select("metro_id", F.lit("repeated").alias("kind"))
    return problems.join(both, ["kind", "metro_id"], "left_anti")


@query("geo_disagreement", f"WITH {_P} SELECT CASE WHEN point % 5 = 0 THEN 'lost' WHEN point % 3 = 0 THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM p GROUP BY 1")
def geo_disagreement(spark, d):
    p = _points(spark, d)
    new = F.when(F.col("point") % 5 == 0, F.lit(None)).when(F.col("point") % 3 == 0, "b").otherwise("a")
    return geometry.disagreement(p.select("point", F.lit("a").alias("metro_id")), p.select("point", new.alias("metro_id")))


QUERIES = Q
