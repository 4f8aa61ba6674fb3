"""Projections, filters, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import ip
from driftline.functions.compat import count_or_null, drop_last_parts, extract, finite, sequence0, strict_greatest, strip_suffix
from driftline.harness.base import DAY, H, H1, M, hops, measurements, one_per_ttl, table
from driftline.operators import joins, paths

Q = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = (f, sql)
        return f

    return keep


L = lambda c: F.col(c).cast("long").alias(c)
S = lambda c, n=None: F.col(c).cast("string").alias(n or c)
J = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- scans, projections, filters ---


@query("scan_window", f"WITH {M} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM m WHERE day BETWEEN DATE '{DAY}' - 7 AND DATE '{DAY}' GROUP BY 1")
def scan_window(spark, d):
    day = F.to_date(F.lit(DAY))
    return measurements(spark, d).where(F.col("day").between(F.date_sub(day, 7), day)).groupBy(S("day")).agg(F.count(F.lit(1)).alias("n"))


@query("proj_struct_field", "SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS prio FROM orders")
def proj_struct_field(spark, d):
    o = table(spark, d, "orders").select(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio")).alias("client")).alias("r"))
    return o.select("r.id", "r.client.cust", "r.client.prio")


@query("proj_kv_lookup", "SELECT event_id, event_type AS a, NULL AS b FROM events")
def proj_kv_lookup(spark, d):
    """The first entry of a name in a key/value list; null without one."""
    pair = lambda k, v: F.struct(F.lit(k).alias("Name"), v.cast("string").alias("Value"))
    e = table(spark, d, "events").select("event_id", F.array(pair("type", F.col("event_type")), pair("type", F.lit("second")), pair("user", F.col("user_id"))).alias("kv"))
    get = lambda k: F.get(F.filter("kv", lambda x: x.Name == k), 0).getField("Value")
    return e.select("event_id", get("type").alias("a"), get("none").alias("b"))


@query("proj_struct_replace", "SELECT c_custkey, upper(c_mktsegment) AS city, c_nationkey::BIGINT AS cc FROM customer")
def proj_struct_replace(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.struct(F.col("c_mktsegment").alias("City"), F.col("c_nationkey").cast("long").alias("CC")).alias("Geo")).alias("client"))
    c = c.withColumn("client", F.col("client").withField("Geo.City", F.upper("client.Geo.City")))
    return c.select("c_custkey", F.col("client.Geo.City").alias("city"), F.col("client.Geo.CC").alias("cc"))


@query("proj_except", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def proj_except(spark, d):
    return table(spark, d, "nation").drop("n_regionkey").select(L("n_nationkey"), "n_name")


@query("proj_ip_version", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'v6' ELSE 'v4' END AS v FROM part")
def proj_ip_version(spark, d):
    a = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("2001:db8::"), F.hex("p_partkey"))).otherwise(ip.format_v4(F.col("p_partkey") * 7919))
    return table(spark, d, "part").select("p_partkey", ip.version(a).alias("v"))


@query("proj_mode_switch", "SELECT c_custkey, c_mktsegment || '-' || (c_nationkey % 5) || '-' || c_nationkey AS label FROM customer")
def proj_mode_switch(spark, d, granularity="city"):
    label = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey") % 5, F.lit("-"), "c_nationkey") if granularity == "city" else F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", label.alias("label"))


@query("proj_swap_endpoints", "SELECT l_orderkey AS id, min(l_suppkey) AS dst, min(l_partkey) AS src FROM lineitem GROUP BY 1")
def proj_swap_endpoints(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("src"), F.min("l_partkey").alias("dst"))
    return t.select("id", F.col("src").alias("dst"), F.col("dst").alias("src"))


@query("filt_null", "SELECT count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE c_custkey IS NOT NULL")
def filt_null(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    o = table(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left").where(F.col("c_custkey").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("filt_in", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def filt_in(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("filt_or_precedence", "SELECT c_custkey FROM (SELECT *, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 'ist' ELSE 'web' END AS ct FROM customer) WHERE (c_acctbal > 5000 AND c_nationkey < 9) OR ct <> 'ist'")
def filt_or_precedence(spark, d):
    ct = F.when(F.col("c_nationkey") % 4 == 0, F.lit(None)).when(F.col("c_nationkey") % 4 == 1, "ist").otherwise("web")
    return table(spark, d, "customer").where(((F.col("c_acctbal") > 5000) & (F.col("c_nationkey") < 9)) | (ct != "ist")).select("c_custkey")


@query("filt_regex", "SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://[a-z0-9.-]+')")
def filt_regex(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike(r"^https?://[a-z0-9.-]+")).select("page_id", F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"))


@query("filt_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '%L'")
def filt_like(spark, d):
    return table(spark, d, "part").where(F.col("p_name").like("%a%") & F.col("p_type").like("%L")).select("p_partkey")


_PATHS = f"{H1}, p AS (SELECT id, list(node ORDER BY ttl) AS path, list(rtt ORDER BY ttl) AS rtts FROM h1 GROUP BY id)"


def _paths(spark, d):
    s = F.array_sort(F.collect_list(F.struct("ttl", "node", "rtt")))
    return one_per_ttl(spark, d).groupBy("id").agg(s.alias("s")).select("id", F.transform("s", lambda x: x.node).alias("path"), F.transform("s", lambda x: x.rtt).alias("rtts"))


@query("filt_exists_array", f"WITH {_PATHS} SELECT id, len(path)::BIGINT AS n FROM p WHERE len(list_filter(rtts, lambda x: x > 45)) = 0")
def filt_exists_array(spark, d):
    """NOT EXISTS over a null array is true."""
    return _paths(spark, d).where(~F.coalesce(F.exists("rtts", lambda x: x > 45), F.lit(False))).select("id", F.size("path").cast("long").alias("n"))


@query("filt_strict_distance", "SELECT event_id FROM events WHERE NOT (value / 100 > nullif(user_id % 3, 0))")
def filt_strict_distance(spark, d):
    return table(spark, d, "events").where(~((F.col("value") / 100) > F.nullif(F.col("user_id") % 3, F.lit(0)))).select("event_id")


@query("filt_anomaly_flags", f"WITH {M} SELECT id, rtt > 60 AS fwd, loss >= 0.05 AS rev, (rtt > 60 OR loss >= 0.05) AS any_ FROM m WHERE (rtt > 60 OR loss >= 0.05) = FALSE")
def filt_anomaly_flags(spark, d):
    f, r = F.col("rtt") > 60, F.col("loss") >= 0.05
    return measurements(spark, d).select("id", f.alias("fwd"), r.alias("rev"), (f | r).alias("any_")).where(F.col("any_") == F.lit(False))


# --- joins ---


@query("join_inner_group", f"WITH {M}, a AS (SELECT site, asn, count(*) AS n FROM m WHERE day = DATE '{DAY}' GROUP BY ALL), b AS (SELECT site, asn, max(rtt) AS r FROM m WHERE day < DATE '{DAY}' GROUP BY ALL) SELECT site, CAST(asn AS BIGINT) AS asn, n, r FROM a JOIN b USING (site, asn)")
def join_inner_group(spark, d):
    m = measurements(spark, d)
    a = m.where(F.col("day") == DAY).groupBy("site", "asn").agg(F.count(F.lit(1)).alias("n"))
    return a.join(m.where(F.col("day") < DAY).groupBy("site", "asn").agg(F.max("rtt").alias("r")), ["site", "asn"]).select("site", L("asn"), "n", "r")


@query("join_inner_id", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner_id(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 200000").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("join_fanout_baseline", f"WITH {M}, b AS (SELECT DISTINCT site, asn, day FROM m WHERE day < DATE '{DAY}' AND day >= DATE '{DAY}' - 2) SELECT m.id, count(*) AS copies FROM m JOIN b USING (site, asn) WHERE m.day = DATE '{DAY}' GROUP BY 1")
def join_fanout_baseline(spark, d):
    """The right side is not unique by the join key: the fan-out is kept."""
    m = measurements(spark, d)
    b = m.where((F.col("day") < DAY) & (F.col("day") >= F.date_sub(F.to_date(F.lit(DAY)), 2))).select("site", "asn", F.col("day").alias("d2")).distinct()
    return m.where(F.col("day") == DAY).join(b, ["site", "asn"]).groupBy("id").agg(F.count(F.lit(1)).alias("copies"))


@query("join_left_stats", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1")
def join_left_stats(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 9000")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query("join_cross_totals", f"WITH {M}, g AS (SELECT site, count(*) AS n FROM m GROUP BY 1) SELECT site, n, round(n / (SELECT count(*) FROM m), 6) AS share FROM g")
def join_cross_totals(spark, d):
    m = measurements(spark, d)
    total = m.agg(F.count(F.lit(1)).alias("total"))  # one row
    return m.groupBy("site").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("site", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("join_asof_nearest", "SELECT o_custkey AS cust, o_orderkey AS ord FROM (SELECT *, CAST(o_orderdate AS DATE) AS dt FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY abs(date_diff('day', DATE '1996-06-15', dt)), dt <= DATE '1996-06-15' DESC, dt DESC, o_orderkey) = 1")
def join_asof_nearest(spark, d):
    """The order nearest to a day: past before future, then the later, then the lesser key."""
    o = table(spark, d, "orders").select(F.format_string("%012d", "o_orderkey").alias("a_key"), F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), F.to_date("o_orderdate").alias("dt"))
    return joins.nearest_in_time(o, ["cust"], F.col("dt"), F.to_date(F.lit("1996-06-15")), past_first=True).select("cust", "ord")


_IPS = "a AS (SELECT DISTINCT (p_partkey * 2654435761) % 4294967296 AS n FROM part)"
_PREF = "f AS (SELECT DISTINCT p_size % 25 + 8 AS mask, ((p_partkey * 2654435761) % 4294967296) - (((p_partkey * 2654435761) % 4294967296) % (1::BIGINT << (24 - p_size % 25))) AS network, p_size AS asn FROM part WHERE p_size > 10)"


def _addresses(spark, d):
    n = F.pmod(F.col("p_partkey") * F.lit(2654435761), F.lit(4294967296))
    return table(spark, d, "part").select("p_partkey", L("p_size"), n.alias("n"))


def _prefixes(spark, d):
    """Parts of small sizes announce no prefix, so some addresses match none."""
    p = _addresses(spark, d).where("p_size > 10").withColumn("mask", (F.col("p_size") % 25 + 8).cast("int"))
    return p.select(L("mask"), ip.mask_v4(F.col("n"), F.col("mask")).alias("network"), F.col("p_size").alias("asn")).distinct()


@query("join_lpm", f"WITH {_IPS}, {_PREF} SELECT n, mask::BIGINT AS mask, asn::BIGINT AS asn FROM a JOIN f ON network = n - n % (1::BIGINT << (32 - mask)) QUALIFY row_number() OVER (PARTITION BY n ORDER BY mask DESC, asn) = 1")
def join_lpm(spark, d):
    a = _addresses(spark, d).select(ip.format_v4(F.col("n")).alias("ip")).withColumn("n", ip.parse_v4(F.col("ip")))
    return joins.longest_prefix_v4(a, _prefixes(spark, d), [F.col("asn")]).select("n", "mask", "asn")


@query("join_ip_in_net", f"WITH {_IPS}, {_PREF} SELECT n, count(*) AS nets FROM a JOIN f ON n >= network AND n < network + (1::BIGINT << (32 - mask)) GROUP BY 1")
def join_ip_in_net(spark, d):
    f = _prefixes(spark, d)
    a = _addresses(spark, d).select("n").distinct().crossJoin(F.broadcast(joins.masks_in(f)))
    return a.withColumn("network", ip.mask_v4(F.col("n"), F.col("mask"))).join(f, ["network", "mask"]).groupBy("n").agg(F.count(F.lit(1)).alias("nets"))


@query("join_full_outer_prefix", "SELECT coalesce(a.k, b.k)::BIGINT AS k, coalesce(a.x, 0) AS x, coalesce(b.y, 0) AS y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k")
def join_full_outer_prefix(spark, d):
    a = table(spark, d, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    b = table(spark, d, "supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


@query("join_full_outer_revtr", "SELECT o_orderkey, l.n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def join_full_outer_revtr(spark, d):
    """A full outer join whose left side a later filter needs is a left join."""
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders")
    return o.join(l, o.o_orderkey == l.l_orderkey, "full_outer").where("o_orderstatus = 'F'").select("o_orderkey", "n")


@query("join_full_outer_resolved", "SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey OR c_custkey = s_suppkey")
def join_full_outer_resolved(spark, d):
    """An OR of equalities as two equi-joins that have no pair in common, so that no pair is shuffled: a pair
    comes from the least of its common nations, or else from equal keys. Keys come once, with all their nations;
    customers are dealt to as many tasks as a shuffle has, which few bytes would not be, and a nation's to eight joins."""
    nations_of = lambda t, k, n: table(spark, d, t).groupBy(k).agg(F.collect_set(n).alias(n))
    c, s = nations_of("customer", "c_custkey", "c_nationkey"), nations_of("supplier", "s_suppkey", "s_nationkey")
    dealt = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    left = dealt.withColumns({"nation": F.explode("c_nationkey"), "deal": F.pmod(F.xxhash64("c_custkey"), F.lit(8))})
    right = s.withColumn("nation", F.explode("s_nationkey")).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    one = (F.size("c_nationkey") == 1) | (F.size("s_nationkey") == 1)
    a = left.join(right, ["nation", "deal"]).where(one | (F.array_min(F.array_intersect("c_nationkey", "s_nationkey")) == F.col("nation")))
    b = c.join(s, c.c_custkey == s.s_suppkey).where(~F.arrays_overlap("c_nationkey", "s_nationkey"))
    return a.select("c_custkey", "s_suppkey").unionByName(b.select("c_custkey", "s_suppkey"))


@query("join_regex_key", "SELECT p.page_id, q.n FROM pages p JOIN (SELECT regexp_replace(regexp_extract(url, '^https?://([^/:]+)', 1), '\\.$', '') AS host, count(*) AS n FROM pages GROUP BY 1) q ON q.host = regexp_replace(regexp_extract(p.url, '^https?://([^/:]+)', 1), '\\.$', '')")
def join_regex_key(spark, d):
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/:]+)", 1), r"\.$", "")
    p = table(spark, d, "pages").select("page_id", host.alias("host"))
    return p.join(p.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host").select("page_id", "n")


@query("join_semi_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_orderpriority = '1-URGENT'")
def join_semi_subquery(spark, d):
    """IN inside an OR: a flag from a left join with the distinct keys."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "orders").join(c, "o_custkey", "left").where(F.col("hit") | (F.col("o_orderpriority") == "1-URGENT")).agg(F.count(F.lit(1)).alias("n"))


@query("join_anti_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti_exists(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("join_anti_left_null", "SELECT p_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 WHERE l_partkey IS NULL")
def join_anti_left_null(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(l, "p_partkey", "left_anti")


@query("join_not_in", "SELECT n_nationkey::BIGINT AS k, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def join_not_in(spark, d):
    """Null-aware: a null in the list leaves nothing."""
    table(spark, d, "nation").createOrReplaceTempView("__nation")
    table(spark, d, "supplier").createOrReplaceTempView("__supplier")
    return spark.sql("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM __nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM __supplier WHERE s_acctbal > 5000)")


@query("join_exists_self", f"WITH {H} SELECT id, ttl, max(CASE WHEN rtt > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY id) = 1 AS flagged FROM h")
def join_exists_self(spark, d):
    return hops(spark, d).select("id", "ttl", (F.max((F.col("rtt") > 48).cast("int")).over(W.partitionBy("id")) == 1).alias("flagged"))


@query("join_self_consecutive", f"WITH {H1} SELECT id, ttl, node AS a, lead(node) OVER (PARTITION BY id ORDER BY ttl) AS b FROM h1 QUALIFY b IS NOT NULL")
def join_self_consecutive(spark, d):
    h = one_per_ttl(spark, d)
    return h.select("id", "ttl", F.col("node").alias("a"), F.lead("node").over(W.partitionBy("id").orderBy("ttl")).alias("b")).where("b is not null")


@query("join_using", "SELECT o_custkey AS k, count(*) AS n FROM orders JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal < 0) USING (o_custkey) GROUP BY 1")
def join_using(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, on="o_custkey").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("join_lookup_coalesce", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 'M' || s_nationkey END, c.canon, s_name) AS metro FROM supplier LEFT JOIN (SELECT n_nationkey AS k, n_name AS canon FROM nation WHERE n_nationkey % 2 = 0) c ON c.k = s_nationkey")
def join_lookup_coalesce(spark, d):
    c = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("canon"))
    metro = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("M"), "s_nationkey"))
    return table(spark, d, "supplier").join(c, "s_nationkey", "left").select("s_suppkey", F.coalesce(metro, "canon", "s_name").alias("metro"))


_DAILY = f"{M}, v AS (SELECT site, day, count(*) AS n FROM m GROUP BY ALL)"


@query("join_neighbour_window", f"WITH {_DAILY} SELECT a.site, CAST(a.day AS VARCHAR) AS day, count(*) AS others, sum(b.n)::BIGINT AS total FROM v a JOIN v b ON a.site = b.site AND b.day BETWEEN a.day - 7 AND a.day + 7 AND b.day <> a.day GROUP BY ALL")
def join_neighbour_window(spark, d):
    v = measurements(spark, d).groupBy("site", "day").agg(F.count(F.lit(1)).alias("n"))
    return joins.neighbour_window(v, ["site"], "day", 7).groupBy("site", S("day")).agg(F.count(F.lit(1)).alias("others"), F.sum("other_n").alias("total"))


@query("join_multi_meta", "SELECT l_orderkey AS id, l_linenumber::BIGINT AS ln, a.n_name AS f, b.n_name AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = l_partkey % 25")
def join_multi_meta(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("o", F.col("l_partkey") % 25)
    l = l.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("f")), "s_nationkey").join(n.select(F.col("n_nationkey").cast("long").alias("o"), F.col("n_name").alias("t")), "o")
    return l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("ln"), "f", "t")


@query("join_facility", "SELECT n_nationkey::BIGINT AS k, string_agg(s_name, ',' ORDER BY s_name) AS facilities FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def join_facility(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    got = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy(F.col("n_nationkey").cast("long").alias("k")).agg(F.sort_array(F.collect_list("s_name")).alias("f"))
    return got.select("k", F.when(F.size("f") > 0, F.array_join("f", ",")).alias("facilities"))


# --- aggregations ---


@query("agg_count_distinct", f"WITH {M} SELECT site, count(*) AS n, count(DISTINCT ip) AS ips, count(DISTINCT CASE WHEN loss > 0.05 THEN ip END) AS lossy_ips, count(*) FILTER (rtt > 50) AS slow FROM m GROUP BY 1")
def agg_count_distinct(spark, d):
    return measurements(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"), F.countDistinct(F.when(F.col("loss") > 0.05, F.col("ip"))).alias("lossy_ips"), F.count_if(F.col("rtt") > 50).alias("slow"))


@query("agg_sum_min_max_avg", f"WITH {M} SELECT site, round(sum(rtt), 4) AS s, min(rtt) AS lo, max(rtt) AS hi, round(avg(rtt), 6) AS a, round(avg(CASE WHEN loss > 0.05 THEN rtt END), 6) AS aif, max(CASE WHEN loss > 0.05 THEN rtt END) AS mif, round(stddev_samp(rtt), 6) AS sd FROM m GROUP BY 1")
def agg_sum_min_max_avg(spark, d):
    lossy = F.when(F.col("loss") > 0.05, F.col("rtt"))
    return measurements(spark, d).groupBy("site").agg(F.round(F.sum("rtt"), 4).alias("s"), F.min("rtt").alias("lo"), F.max("rtt").alias("hi"), F.round(F.avg("rtt"), 6).alias("a"), F.round(F.avg(lossy), 6).alias("aif"), F.max(lossy).alias("mif"), F.round(F.stddev_samp("rtt"), 6).alias("sd"))


@query("agg_any_value", "SELECT o_custkey AS k, o_orderkey AS ord, o_orderstatus AS st FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def agg_any_value(spark, d):
    """One row's values, so that columns stay consistent: those of the least id."""
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("r"))
    return a.select("k", F.col("r.o_orderkey").alias("ord"), F.col("r.o_orderstatus").alias("st"))


@query("agg_array", f"WITH {M} SELECT site, CAST(asn AS BIGINT) AS asn, count(*) FILTER (loss > 0.05) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (loss > 0.05) AS ids, string_agg(DISTINCT CAST(ip AS VARCHAR), ',' ORDER BY CAST(ip AS VARCHAR)) AS ips FROM m GROUP BY ALL")
def agg_array(spark, d):
    got = measurements(spark, d).groupBy("site", "asn").agg(F.sort_array(F.collect_list(F.when(F.col("loss") > 0.05, F.col("id")))).alias("ids"), F.sort_array(F.collect_set(F.col("ip").cast("string"))).alias("ips"))
    return got.select("site", L("asn"), F.size("ids").cast("long").alias("n"), F.when(F.size("ids") > 0, J(F.col("ids"))).alias("ids"), F.array_join("ips", ",").alias("ips"))


@query("agg_array_ordered", f"WITH {H1} SELECT id, string_agg(node || '@' || ttl, ',' ORDER BY ttl) AS path FROM h1 GROUP BY 1")
def agg_array_ordered(spark, d):
    s = F.array_sort(F.collect_list(F.struct("ttl", "node")))
    return one_per_ttl(spark, d).groupBy("id").agg(F.array_join(F.transform(s, lambda x: F.concat(x.node, F.lit("@"), x.ttl)), ",").alias("path"))


@query("agg_topk_array", "SELECT l_orderkey AS id, arg_min(l_partkey, l_extendedprice * 1000000 + l_partkey) AS part FROM lineitem GROUP BY 1")
def agg_topk_array(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_partkey", F.col("l_extendedprice") * 1000000 + F.col("l_partkey")).alias("part"))


@query("agg_approx_quantiles")
def agg_approx_quantiles(spark, d):
    q = F.percentile_approx("rtt", F.array(*[F.lit(p) for p in (0.01, 0.1, 0.2, 0.5, 0.9, 0.95)]), 10_000)
    return measurements(spark, d).groupBy("site").agg(q.alias("q")).select("site", *[F.col("q")[i].alias(f"q{i}") for i in range(6)])


@query("agg_group_min_first", f"WITH {H1}, f AS (SELECT id, node % 7 AS x, min(ttl) AS t FROM h1 GROUP BY ALL) SELECT id, string_agg(CAST(x AS VARCHAR), '>' ORDER BY t) AS path FROM f GROUP BY 1")
def agg_group_min_first(spark, d):
    p = paths.ordered_distinct(one_per_ttl(spark, d).withColumn("x", F.col("node") % 7), "x")
    return p.select("id", F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"))


@query("agg_distinct", f"WITH {M} SELECT DISTINCT site, CAST(asn AS BIGINT) AS asn FROM m")
def agg_distinct(spark, d):
    return measurements(spark, d).select("site", L("asn")).distinct()


@query("agg_having", f"WITH {M} SELECT site, CAST(asn AS BIGINT) AS asn, count(*) AS n FROM m GROUP BY ALL HAVING count(*) FILTER (loss > 0.098) = 0")
def agg_having(spark, d):
    g = measurements(spark, d).groupBy("site", L("asn")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("loss") > 0.098).alias("c"))
    return g.where("c = 0").drop("c")


@query("agg_two_level", f"WITH {M}, g AS (SELECT site, asn, avg(rtt) AS a FROM m GROUP BY ALL) SELECT site, round(avg(a), 6) AS mean, round(max(a), 6) AS most FROM g GROUP BY 1")
def agg_two_level(spark, d):
    g = measurements(spark, d).groupBy("site", "asn").agg(F.avg("rtt").alias("a"))
    return g.groupBy("site").agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.max("a"), 6).alias("most"))


@query("agg_group_concat_key", f"WITH {M} SELECT CAST(asn AS BIGINT) || ' - ' || site || ' - ' || CASE WHEN ip % 2 = 0 THEN 'a' END AS pair, count(*) AS n FROM m GROUP BY 1")
def agg_group_concat_key(spark, d):
    """A null part makes the key null, as concat does (concat_ws would not)."""
    pair = F.concat(F.col("asn").cast("string"), F.lit(" - "), "site", F.lit(" - "), F.when(F.col("ip") % 2 == 0, "a"))
    return measurements(spark, d).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_mode", f"WITH {M}, c AS (SELECT ip, site, count(*) AS n FROM m GROUP BY ALL) SELECT ip, arg_max(site, n || site) AS site FROM (SELECT ip, site, lpad(CAST(n AS VARCHAR), 9, '0') AS n FROM c) GROUP BY ip")
def agg_mode(spark, d):
    c = measurements(spark, d).groupBy("ip", "site").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("ip").agg(F.max_by("site", F.struct("n", "site")).alias("site"))


@query("agg_pivot", f"WITH {M} SELECT site, count(DISTINCT CASE WHEN loss > 0.05 THEN ip END) AS anomalous, count(DISTINCT CASE WHEN loss <= 0.05 THEN ip END) AS healthy FROM m GROUP BY 1")
def agg_pivot(spark, d):
    kind = F.when(F.col("loss") > 0.05, "anomalous").otherwise("healthy")
    return measurements(spark, d).withColumn("kind", kind).groupBy("site").pivot("kind", ["anomalous", "healthy"]).agg(F.countDistinct("ip"))


@query("agg_set_index", f"WITH {M} SELECT site, string_agg(DISTINCT CAST(asn AS VARCHAR), ',' ORDER BY CAST(asn AS VARCHAR)) AS pairs FROM m WHERE loss > 0.095 GROUP BY 1")
def agg_set_index(spark, d):
    return measurements(spark, d).where("loss > 0.095").groupBy("site").agg(F.array_join(F.sort_array(F.collect_set(F.col("asn").cast("string"))), ",").alias("pairs"))


_EDGES = f"{H1}, e AS (SELECT id, ttl, node AS a, lead(node) OVER (PARTITION BY id ORDER BY ttl) AS b FROM h1 QUALIFY b IS NOT NULL)"


def _edges(spark, d):
    h = one_per_ttl(spark, d)
    return h.select("id", "ttl", F.col("node").alias("a"), F.lead("node").over(W.partitionBy("id").orderBy("ttl")).alias("b")).where("b is not null")


@query("agg_node_counts", f"WITH {_EDGES} SELECT node, count(*) AS n FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def agg_node_counts(spark, d):
    e = _edges(spark, d)
    part = lambda c: e.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return part("a").unionByName(part("b")).groupBy("node").agg(F.sum("n").alias("n"))


# --- windows ---


def _by():
    return W.partitionBy("id").orderBy("ttl")


def _run():
    return _by().rowsBetween(W.unboundedPreceding, 0)


@query("win_row_number", f"WITH {H} SELECT id, ttl, node, rtt, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN rtt > 25 THEN 0 ELSE 1 END, ttl DESC, node, rtt, part) AS rn FROM h")
def win_row_number(spark, d):
    w = W.partitionBy("id").orderBy(F.when(F.col("rtt") > 25, 0).otherwise(1), F.desc("ttl"), "node", "rtt", "part")
    return hops(spark, d).select("id", "ttl", "node", "rtt", F.row_number().over(w).alias("rn"))


@query("win_count", f"WITH {H} SELECT id, ttl, part, count(*) OVER (PARTITION BY id) AS n, (SELECT count(DISTINCT node) FROM h x WHERE x.id = h.id) AS nodes FROM h")
def win_count(spark, d):
    """COUNT(DISTINCT) OVER as the size of a collected set."""
    w = W.partitionBy("id")
    return hops(spark, d).select("id", "ttl", "part", F.count(F.lit(1)).over(w).alias("n"), F.size(F.collect_set("node").over(w)).cast("long").alias("nodes"))


@query("win_percentile_cont", f"WITH {M} SELECT id, round(quantile_cont(rtt, 0.5) OVER (PARTITION BY site), 6) AS med FROM m")
def win_percentile_cont(spark, d):
    m = measurements(spark, d)
    return m.join(m.groupBy("site").agg(F.round(F.percentile("rtt", F.lit(0.5)), 6).alias("med")), "site").select("id", "med")


@query("win_avg_stddev_sum", f"WITH {M} SELECT id, round(avg(rtt) OVER (PARTITION BY site), 6) AS a, round(stddev_samp(rtt) OVER (PARTITION BY site), 6) AS sd, sum(ip) OVER (PARTITION BY site)::BIGINT AS s FROM m")
def win_avg_stddev_sum(spark, d):
    w = W.partitionBy("site")
    return measurements(spark, d).select("id", F.round(F.avg("rtt").over(w), 6).alias("a"), F.round(F.stddev_samp("rtt").over(w), 6).alias("sd"), F.sum("ip").over(w).alias("s"))


@query("win_first_value", f"WITH {H} SELECT DISTINCT id, first_value(rtt) OVER (PARTITION BY id ORDER BY ttl DESC, rtt) AS r FROM h")
def win_first_value(spark, d):
    return hops(spark, d).select("id", F.first("rtt").over(W.partitionBy("id").orderBy(F.desc("ttl"), "rtt")).alias("r")).distinct()


_GAPS = f"{H1}, g AS (SELECT id, ttl, CASE WHEN node % 3 > 0 THEN node END AS v FROM h1)"


@query("win_fill", f"WITH {_GAPS} SELECT id, ttl, last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fwd, last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bwd, last_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, first_value(v IGNORE NULLS) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM g")
def win_fill(spark, d):
    """win_last_value_ignore_nulls and win_prev_next_non_null."""
    g = one_per_ttl(spark, d).withColumn("v", F.when(F.col("node") % 3 > 0, F.col("node")))
    down = W.partitionBy("id").orderBy(F.desc("ttl")).rowsBetween(W.unboundedPreceding, 0)
    return g.select(
        "id", "ttl", F.last("v", True).over(_run()).alias("fwd"), F.last("v", True).over(down).alias("bwd"),
        F.last("v", True).over(_by().rowsBetween(W.unboundedPreceding, -1)).alias("prev"), F.first("v", True).over(_by().rowsBetween(1, W.unboundedFollowing)).alias("next"),
    )


@query("win_min_partition_if", f"WITH {H} SELECT id, ttl, part, min(CASE WHEN rtt > 25 THEN ttl END) OVER (PARTITION BY id) AS first_slow FROM h")
def win_min_partition_if(spark, d):
    return hops(spark, d).select("id", "ttl", "part", F.min(F.when(F.col("rtt") > 25, F.col("ttl"))).over(W.partitionBy("id")).alias("first_slow"))


@query("win_lag", f"WITH {H1} SELECT id, ttl, lag(rtt) OVER (PARTITION BY id ORDER BY ttl) AS up, lag(rtt) OVER (PARTITION BY id ORDER BY ttl DESC) AS down FROM h1")
def win_lag(spark, d):
    return one_per_ttl(spark, d).select("id", "ttl", F.lag("rtt").over(_by()).alias("up"), F.lag("rtt").over(W.partitionBy("id").orderBy(F.desc("ttl"))).alias("down"))


@query("win_running", f"WITH {H1} SELECT id, ttl, round(sum(rtt) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS total, count(CASE WHEN rtt > 40 THEN 1 END) OVER (PARTITION BY id ORDER BY ttl ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS seen FROM h1")
def win_running(spark, d):
    """win_running_sum and win_running_count_if."""
    return one_per_ttl(spark, d).select("id", "ttl", F.round(F.sum("rtt").over(_run()), 6).alias("total"), (F.count(F.when(F.col("rtt") > 40, 1)).over(_run()) > 0).alias("seen"))


@query("win_in_subquery", f"WITH {_PATHS} SELECT id, list_sum(list_transform(generate_series(2, len(rtts)), lambda i: CASE WHEN rtts[i] > rtts[i - 1] THEN 1 ELSE 0 END))::BIGINT AS rises FROM p WHERE len(rtts) > 1")
def win_in_subquery(spark, d):
    """A window over an array's elements, without leaving the row."""
    rise = F.zip_with(F.slice("rtts", 2, F.size("rtts")), F.slice("rtts", 1, F.size("rtts") - 1), lambda b, a: (b > a).cast("long"))
    return _paths(spark, d).where(F.size("rtts") > 1).select("id", F.aggregate(rise, F.lit(0).cast("long"), lambda s, x: s + x).alias("rises"))


@query("win_qualify", "SELECT o_custkey AS k, o_orderkey AS ord FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def win_qualify(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"))


@query("win_median_excl_self", f"WITH {_DAILY} SELECT a.site, CAST(a.day AS VARCHAR) AS day, any_value(a.n) AS n, quantile_cont(b.n, 0.5) AS med, any_value(a.n) / quantile_cont(b.n, 0.5) < 0.5 AS stale FROM v a JOIN v b ON a.site = b.site AND b.day BETWEEN a.day - 7 AND a.day + 7 AND b.day <> a.day GROUP BY a.site, a.day")
def win_median_excl_self(spark, d):
    v = measurements(spark, d).groupBy("site", "day").agg(F.count(F.lit(1)).alias("n"))
    j = joins.neighbour_window(v, ["site"], "day", 7).groupBy("site", S("day"), "n").agg(F.percentile("other_n", F.lit(0.5)).alias("med"))
    return j.withColumn("stale", F.col("n") / F.col("med") < 0.5)


# --- sort, limit, top-k, sets ---


@query("topk_global", f"WITH {M}, g AS (SELECT site, CAST(asn AS BIGINT) AS asn, count(*) FILTER (loss > 0.05) AS c FROM m GROUP BY ALL) SELECT * FROM g ORDER BY c DESC, site, asn LIMIT 11")
def topk_global(spark, d):
    g = measurements(spark, d).groupBy("site", L("asn")).agg(F.count_if(F.col("loss") > 0.05).alias("c"))
    return g.orderBy(F.desc("c"), "site", "asn").limit(11)


@query("topk_per_group", "SELECT n_regionkey::BIGINT AS r, n_name FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 2")
def topk_per_group(spark, d):
    w = W.partitionBy("n_regionkey").orderBy("n_name")
    return table(spark, d, "nation").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select(F.col("n_regionkey").cast("long").alias("r"), "n_name")


@query("topk_in_array", "SELECT vec_id, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'DESC')[1] AS top, list_position(embedding, list_max(embedding))::BIGINT AS at FROM embeddings")
def topk_in_array(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.sort_array("embedding", False)[0].cast("double").alias("top"), F.array_position("embedding", F.array_max("embedding")).alias("at"))


@query("sort_array_output", f"WITH {M} SELECT site, string_agg(DISTINCT CAST(ip AS VARCHAR), ' ' ORDER BY CAST(ip AS VARCHAR) DESC) AS ips FROM m GROUP BY 1")
def sort_array_output(spark, d):
    return measurements(spark, d).groupBy("site").agg(F.array_join(F.sort_array(F.collect_set(F.col("ip").cast("string")), False), " ").alias("ips"))


@query("limit_1", f"WITH {M} SELECT EXISTS (SELECT 1 FROM m WHERE loss > 0.098) AS any_, EXISTS (SELECT 1 FROM m WHERE loss > 2) AS none")
def limit_1(spark, d):
    m = measurements(spark, d)
    probe = lambda c: not m.where(c).limit(1).isEmpty()
    return spark.range(1).select(F.lit(probe("loss > 0.098")).alias("any_"), F.lit(probe("loss > 2")).alias("none"))


@query("set_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) GROUP BY 1")
def set_union_all(spark, d):
    a = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("set_union_distinct", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")).union(table(spark, d, "supplier").select(F.col("s_nationkey").cast("long"))).distinct()


@query("set_prefer_first", "SELECT o_orderkey AS id, 'a' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 'b' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def set_prefer_first(spark, d):
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("a").alias("src"))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("b").alias("src")).distinct()
    return a.unionByName(b.join(a, "id", "left_anti"))


@query("set_difference", f"WITH {M} SELECT DISTINCT ip FROM m WHERE day = DATE '{DAY}' EXCEPT SELECT ip FROM m WHERE day = DATE '{DAY}' - 1")
def set_difference(spark, d):
    m = measurements(spark, d)
    return m.where(F.col("day") == DAY).select("ip").distinct().exceptAll(m.where(F.col("day") == F.date_sub(F.to_date(F.lit(DAY)), 1)).select("ip").distinct())


# --- scalar functions ---


@query("fn_conditional", "SELECT event_id, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS a, coalesce(nullif(user_id % 4, 0), -1) AS b, CASE WHEN nullif(user_id % 3, 0) IS NULL THEN NULL ELSE greatest(user_id % 3, 1) END AS c FROM events")
def fn_conditional(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("value") > 50, "hi").otherwise("lo").alias("a"), F.coalesce(F.nullif(F.col("user_id") % 4, F.lit(0)), F.lit(-1)).alias("b"), strict_greatest(F.nullif(F.col("user_id") % 3, F.lit(0)), F.lit(1)).alias("c"))


@query("fn_safe", "SELECT event_id, round(value / nullif(user_id % 3, 0), 6) AS q, TRY_CAST(event_type AS INT) AS c, TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS u FROM events")
def fn_safe(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.try_divide(F.col("value"), F.col("user_id") % 3), 6).alias("q"), F.col("event_type").try_cast("int").alias("c"), F.col("user_id").cast("string").try_cast("long").alias("u"))


@query("fn_array", f"WITH {_PATHS} SELECT id, path[2] AS second, path[99] AS none, nullif(len(list_filter(rtts, lambda x: x > 40)), 0) AS slow, array_to_string(list_reverse(path), '-') AS back, len(list_distinct(path))::BIGINT AS uniq, len(generate_series(0, len(path) - 2))::BIGINT AS steps FROM p")
def fn_array(spark, d):
    p = _paths(spark, d)
    return p.select(
        "id", F.get("path", F.lit(1)).alias("second"), F.get("path", F.lit(98)).alias("none"), count_or_null(F.filter("rtts", lambda x: x > 40)).alias("slow"),
        F.array_join(F.transform(F.reverse("path"), lambda x: x.cast("string")), "-").alias("back"), F.size(F.array_distinct("path")).cast("long").alias("uniq"),
        F.size(sequence0(F.lit(0), F.size("path") - 2)).cast("long").alias("steps"),
    )


@query("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS s, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")
def fn_math(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.abs(b).alias("a"), F.round(F.sqrt(F.abs(b)), 6).alias("s"), F.floor(b).alias("f"))


@query("fn_string", "SELECT p_partkey, split_part(p_type, ' ', 1) AS w1, trim('  ' || p_brand || ' ') AS t, left(p_name, 4) AS l, length(p_name) AS n, substr(p_name, 2, 3) AS s, strpos(p_name, 'a') AS pos, ends_with(p_type, 'L') AS e, starts_with(p_brand, 'B') AS st, p_brand || ':' || p_size AS cc FROM part")
def fn_string(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.split("p_type", " ")[0].alias("w1"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("t"), F.left("p_name", F.lit(4)).alias("l"), F.length("p_name").alias("n"),
        F.substring("p_name", 2, 3).alias("s"), F.instr("p_name", "a").alias("pos"), F.endswith("p_type", F.lit("L")).alias("e"), F.startswith("p_brand", F.lit("B")).alias("st"), F.concat("p_brand", F.lit(":"), "p_size").alias("cc"),
    )


@query("fn_regex", "SELECT page_id, regexp_matches(url, '[0-9]') AS c, nullif(regexp_extract(url, '([0-9]+)$', 1), '') AS x, regexp_replace(url, '^https?://', '') AS r FROM pages")
def fn_regex(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").rlike("[0-9]").alias("c"), extract(F.col("url"), "([0-9]+)$").alias("x"), F.regexp_replace("url", "^https?://", "").alias("r"))


@query("fn_label_parse", "WITH x AS (SELECT c_custkey, 'New-' || c_mktsegment || '-R' || (c_nationkey % 5) || '-C' || c_nationkey AS label, '-R' || (c_nationkey % 5) || '-C' || c_nationkey AS suffix FROM customer) SELECT c_custkey, regexp_replace(label, '-[^-]*-[^-]*$', '') AS city, replace(label, suffix, '') AS stripped, split_part(label, '-', 1) AS head FROM x")
def fn_label_parse(spark, d):
    suffix = F.concat(F.lit("-R"), F.col("c_nationkey") % 5, F.lit("-C"), "c_nationkey")
    label = F.concat(F.lit("New-"), "c_mktsegment", suffix)
    return table(spark, d, "customer").select("c_custkey", drop_last_parts(label).alias("city"), strip_suffix(label, suffix).alias("stripped"), F.split(label, "-")[0].alias("head"))


@query("fn_datetime", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS diff, CAST(CAST(ts AS DATE) - 7 AS VARCHAR) AS wk, CAST(CAST(CAST(ts AS DATE) - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS mon, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS m0, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS h FROM events")
def fn_datetime(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").select(
        "event_id", day.cast("string").alias("d"), F.datediff(day, F.to_date(F.lit("2024-01-01"))).cast("long").alias("diff"), F.date_sub(day, 7).cast("string").alias("wk"),
        F.add_months(day, -1).cast("string").alias("mon"), F.trunc(day, "MM").cast("string").alias("m0"), F.unix_timestamp(F.date_trunc("hour", "ts")).alias("h"),
    )


@query("fn_null_safe", "SELECT o_orderkey, CASE WHEN c.k IS NULL THEN 'fallback' ELSE c.v END AS v FROM orders LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 3 = 0) c ON c.k = o_custkey")
def fn_null_safe(spark, d):
    """A fallback keyed on the match, not on the value: a matched null stays null."""
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("v"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("k"), "left").select("o_orderkey", F.when(F.col("k").isNull(), "fallback").otherwise(F.col("v")).alias("v"))


@query("sink_sanitize", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events")
def sink_sanitize(spark, d):
    bad = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return table(spark, d, "events").select("event_id", finite(bad).alias("v"))


@query("ip_functions", "WITH a AS (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS n FROM part) SELECT p_partkey, n, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS ip, n - n % 256 AS net24, (n >= 167772160 AND n < 184549376) OR (n >= 2886729728 AND n < 2887778304) OR (n >= 3232235520 AND n < 3232301056) OR (n >= 1681915904 AND n < 1686110208) AS private FROM a")
def ip_functions(spark, d):
    """ip_parse, ip_mask, ip_private."""
    a = _addresses(spark, d).select("p_partkey", ip.format_v4(F.col("n")).alias("ip")).withColumn("n", ip.parse_v4(F.col("ip")))
    return a.select("p_partkey", "n", "ip", ip.mask_v4(F.col("n"), F.lit(24)).alias("net24"), ip.private_v4(F.col("n")).alias("private"))


@query("ip_mask_explode", "WITH a AS (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS n FROM part) SELECT p_partkey, mask::BIGINT AS mask, n - n % (1::BIGINT << (32 - mask)) AS network FROM a, generate_series(8, 32) g(mask)")
def ip_mask_explode(spark, d):
    a = _addresses(spark, d).withColumn("mask", F.explode(F.sequence(F.lit(8), F.lit(32))))
    return a.select("p_partkey", L("mask"), ip.mask_v4(F.col("n"), F.col("mask")).alias("network"))


@query("ip_text_parts", "SELECT p_partkey, '10.0.0.' || (p_partkey % 256) AS net, p_size::BIGINT AS bits, '192.0.2.' || (p_partkey % 256) AS suffix FROM part")
def ip_text_parts(spark, d):
    """ip_prefix_split and ip_hop_suffix."""
    host = F.concat(F.lit("10.0.0."), F.col("p_partkey") % 256, F.lit("/"), "p_size")
    net, bits = ip.prefix_parts(host)
    return table(spark, d, "part").select("p_partkey", net.alias("net"), bits.cast("long").alias("bits"), ip.hop_suffix(F.concat(F.lit("id_x_192.0.2."), F.col("p_partkey") % 256)).alias("suffix"))


@query("ip_parse_v6", "WITH a AS (SELECT p_partkey, p_partkey % 5 > 0 AS ok, (CAST(p_partkey AS HUGEINT) % 65536) * 65536 + 2306139568115548160::HUGEINT AS hi FROM part) SELECT p_partkey, CASE WHEN ok THEN hi::BIGINT END AS hi, CASE WHEN ok THEN 1::BIGINT END AS lo, CASE WHEN ok THEN 16 END AS len, CASE WHEN ok THEN (hi - hi % 65536)::BIGINT END AS net_hi, CASE WHEN ok THEN 0::BIGINT END AS net_lo, CASE WHEN ok THEN false END AS private FROM a")
def ip_parse_v6(spark, d):
    a = F.when(F.col("p_partkey") % 5 == 0, "junk").otherwise(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("p_partkey") % 65536)), F.lit("::1")))
    p = table(spark, d, "part").select("p_partkey", ip.parse(a).alias("x"))
    hi, lo = ip.mask_v6(F.col("x.hi"), F.col("x.lo"), F.lit(48))
    return p.select("p_partkey", "x.hi", "x.lo", "x.len", hi.alias("net_hi"), lo.alias("net_lo"), ip.private_v6(F.col("x.hi"), F.col("x.lo")).alias("private"))


QUERIES = Q
