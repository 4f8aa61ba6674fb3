"""Detection queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import stats
from driftline.harness.base import DAY, KM, M, N, cdf, measurements, nations, table
from driftline.operators import paths
from driftline.plans import detect as D

CFG = D.Detection(day=DAY)
BASE = f"""{M},
b0 AS (SELECT *, count(*) OVER (PARTITION BY asn, site) AS total, row_number() OVER (PARTITION BY asn, site, ip ORDER BY id) AS n FROM m
 WHERE day >= DATE '{DAY}' - 7 AND day < DATE '{DAY}'),
b AS (SELECT * FROM b0 WHERE n <= floor(0.4 * total)),
t AS (SELECT * FROM m WHERE day = DATE '{DAY}')"""


RATES = ("throughput", "upload_throughput")


def _stats(side: str, name: str) -> str:
    rates = "".join(f", quantile_cont({r}, 0.5) AS {side}_median_{r}, avg({r}) AS {side}_mean_{r}" for r in RATES)
    return f"""{name} AS (SELECT asn, site, count(*) AS {side}_n, count(DISTINCT ip) AS {side}_ips, quantile_cont(rtt, 0.5) AS {side}_median, quantile_cont(loss, 0.95) AS {side}_p95_loss,
 avg(rtt) AS {side}_mean, var_samp(rtt) AS {side}_var, count(*) FILTER (loss > 0.01) AS {side}_lossy, count(loss) AS {side}_losses, count(*) FILTER (loss > 0.01) / nullif(count(loss), 0) AS {side}_lossy_share{rates} FROM {'b' if side == 'base' else 't'} GROUP BY asn, site)"""


RANKS = """pool AS (SELECT asn, site, rtt AS x, 1 AS a, 0 AS c FROM b UNION ALL SELECT asn, site, rtt, 0, 1 FROM t),
pc AS (SELECT asn, site, x, sum(a) AS a, sum(c) AS c FROM pool WHERE x IS NOT NULL GROUP BY ALL),
pr AS (SELECT *, sum(a + c) OVER w - (a + c) + (a + c + 1) / 2 AS mid, sum(a) OVER (PARTITION BY asn, site) AS n1, sum(c) OVER (PARTITION BY asn, site) AS n2,
 sum(a) OVER w AS ca, sum(c) OVER w AS cc, lead(x) OVER (PARTITION BY asn, site ORDER BY x) - x AS gap FROM pc
 WINDOW w AS (PARTITION BY asn, site ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rs AS (SELECT asn, site, max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2, sum(mid * a) AS r1, sum(CAST((a + c) * (a + c) * (a + c) - (a + c) AS DOUBLE)) AS ties,
 coalesce(sum(abs(ca / n1 - cc / n2) * gap), 0) AS distance FROM pr WHERE n1 > 0 AND n2 > 0 GROUP BY asn, site),
ru AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u, n1 * n2 / 2 AS mu, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM rs),
rz AS (SELECT *, CASE WHEN sd = 0 THEN -1e308 ELSE (u - mu - 0.5) / sd END AS z FROM ru)"""


def welch_p_sql(t: str, df: str) -> str:
    """Two-sided p-value by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    at = f"atan(abs({t}) / sqrt({df}))"
    area = f"list_sum(list_transform(range(2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({at} * i / 2000), {df} - 1))) * {at} / 6000"
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {area})"


def _compared(pool: str, keys: str, p: str) -> str:
    """Tests of (keys, x, a, c) by sorting all values of a key: {p}z has n1, n2, u, z, distance, t, df."""
    return f"""{p}c AS (SELECT {keys}, x, sum(a) AS a, sum(c) AS c FROM {pool} GROUP BY ALL),
{p}m AS (SELECT {keys}, avg(x) FILTER (a = 1) AS m1, var_samp(x) FILTER (a = 1) AS v1, avg(x) FILTER (c = 1) AS m2, var_samp(x) FILTER (c = 1) AS v2 FROM {pool} GROUP BY ALL),
{p}r AS (SELECT *, sum(a + c) OVER w - (a + c) + (a + c + 1) / 2 AS mid, sum(a) OVER (PARTITION BY {keys}) AS n1, sum(c) OVER (PARTITION BY {keys}) AS n2, sum(a) OVER w AS ca, sum(c) OVER w AS cc,
 lead(x) OVER (PARTITION BY {keys} ORDER BY x) - x AS gap FROM {p}c WINDOW w AS (PARTITION BY {keys} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}s AS (SELECT {keys}, max(n1)::DOUBLE AS n1, max(n2)::DOUBLE AS n2, sum(mid * a) AS r1, sum(CAST((a + c) * (a + c) * (a + c) - (a + c) AS DOUBLE)) AS ties,
 coalesce(sum(abs(ca / n1 - cc / n2) * gap), 0) AS distance FROM {p}r WHERE n1 > 0 AND n2 > 0 GROUP BY {keys}),
{p}u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd,
 (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t, pow(v1 / n1 + v2 / n2, 2) / nullif(pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1), 0) AS df FROM {p}s JOIN {p}m USING ({keys})),
{p}z AS (SELECT *, CASE WHEN sd = 0 THEN -1e308 ELSE (u - n1 * n2 / 2 - 0.5) / sd END AS z FROM {p}u)"""


def _detect_sql(group: str) -> str:
    """Every rule of the detection over one grouping, permutations included; ends with the relation ``j``."""
    stats_ = ", ".join([_stats("base", "sb"), _stats("day", "sd")]).replace("asn, site", group)
    sides = " UNION ALL ".join(f"SELECT {group}, '{m}' AS metric, id, {x}::DOUBLE AS x, {a} AS a, {1 - a} AS c FROM {d}" for d, a in (("b", 1), ("t", 0)) for m, x in (("rtt", "rtt"), *((r, r) for r in RATES), ("severity", "CASE WHEN loss > 0.01 THEN loss END")))
    side = lambda m: f"(SELECT * FROM tested WHERE metric = '{m}') {m[0]}_"
    keys = f"{group}, metric"
    fell = " UNION ALL ".join(f"SELECT {group}, '{r}' AS metric, x.distance, x.n1 FROM tested x JOIN sb USING ({group}) JOIN sd USING ({group}) WHERE x.metric = '{r}' AND x.wp < 0.05 AND x.p < 0.05 AND (day_median_{r} - base_median_{r}) / nullif(base_median_{r}, 0) <= -0.2" for r in RATES)
    joins = " ".join(f"LEFT JOIN {side(m)} USING ({group})" for m in ("rtt", *RATES, "severity"))
    base = BASE if group == "asn, site" else BASE.replace("asn, site", group)
    return f"""WITH {base}, {stats_}, pool AS (SELECT * FROM ({sides}) WHERE x IS NOT NULL), {_compared('pool', keys, 'q')},
tested AS (SELECT *, 2 * (1 - {cdf('abs(z)')}) AS p, {welch_p_sql('t', 'df')} AS wp FROM qz WHERE least(n1, n2) >= CASE WHEN metric = 'severity' THEN 5 ELSE 3 END),
fell AS ({fell}),
dealt AS (SELECT {keys}, j, x, CASE WHEN row_number() OVER (PARTITION BY {keys}, j ORDER BY md5(j || '-' || id), id) <= n1 THEN 1 ELSE 0 END AS a FROM pool JOIN fell USING ({keys}), range(1, 51) r(j)),
mixed AS (SELECT *, 1 - a AS c FROM dealt), {_compared('mixed', keys + ', j', 'p')},
perm AS (SELECT {keys}, count(*) FILTER (pz.distance >= fell.distance * (1 - 1e-9) - 1e-12) / 50 AS pp FROM pz JOIN fell USING ({keys}) GROUP BY ALL),
gt AS (SELECT * FROM perm WHERE metric = 'throughput'), gu AS (SELECT * FROM perm WHERE metric = 'upload_throughput'),
j AS (SELECT sb.*, sd.* EXCLUDE ({group}), r_.u, r_.z, r_.p, r_.wp, r_.distance, r_.t, r_.df, CASE WHEN r_.z IS NOT NULL THEN {_LOSS} END AS zl, s_.z AS sz, s_.p AS sp,
 t_.p AS tp, t_.wp AS twp, t_.distance AS tdist, u_.p AS up, u_.wp AS uwp, u_.distance AS udist, gt.pp AS tpp, gu.pp AS upp,
 (day_median_throughput - base_median_throughput) / nullif(base_median_throughput, 0) AS tchange, (day_median_upload_throughput - base_median_upload_throughput) / nullif(base_median_upload_throughput, 0) AS uchange,
 FROM sb JOIN sd USING ({group}) {joins} LEFT JOIN gt USING ({group}) LEFT JOIN gu USING ({group})),
f AS (SELECT *, CAST(coalesce((p < 0.05 OR wp < 0.05) AND day_median >= base_median + 5, false) AS INT) AS anomaly_rtt,
 CAST(coalesce(tpp < 0.05, false) AS INT) AS anomaly_throughput, CAST(coalesce(upp < 0.05, false) AS INT) AS anomaly_upload_throughput,
 CAST(coalesce(zl > 1.645 AND day_lossy_share >= 0.1 AND day_lossy_share >= base_lossy_share + 0.1 AND (sz IS NULL OR sp < 0.05 OR day_p95_loss >= greatest(0.03, base_p95_loss + 0.02)), false) AS INT) AS anomaly_loss FROM j)"""


_LOSS = "(CASE WHEN base_losses > 0 AND day_losses > 0 THEN (day_lossy / day_losses - base_lossy / base_losses) / nullif(sqrt((base_lossy + day_lossy) / (base_losses + day_losses) * (1 - (base_lossy + day_lossy) / (base_losses + day_losses)) * (1.0 / base_losses + 1.0 / day_losses)), 0) END)"
FLAGS = ["anomaly_rtt", "anomaly_throughput", "anomaly_upload_throughput", "anomaly_loss"]
SHOWN = {
    "base_median": "base_median", "day_median": "day_median", "mwu.U": "u", "mwu.Z": "z", "mwu.p_value": "p", "distance": "distance", "welch.t_stat": "t", "welch_p": "wp", "z_loss": "zl",
    "severity.p_value": "sp", "change_throughput": "tchange", "mwu_throughput.p_value": "tp", "welch_p_throughput": "twp", "distance_throughput": "tdist", "p_throughput": "tpp",
    "change_upload_throughput": "uchange", "mwu_upload_throughput.p_value": "up", "welch_p_upload_throughput": "uwp", "distance_upload_throughput": "udist", "p_upload_throughput": "upp",
}
_SHOWN_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in SHOWN.values()) + ", " + ", ".join(FLAGS)


def _shown():
    return [*[F.round(x, 6).alias(c) for x, c in SHOWN.items()], *FLAGS]


def detect_degradation(spark, sf_dir):
    d = D.detect(measurements(spark, sf_dir), CFG)
    return d.select(F.col("asn").cast("long").alias("asn"), "site", "base_n", "base_ips", "day_n", F.round("welch.degrees_of_freedom", 4).alias("df"), *_shown())


BY_SITE = D.Detection(day=DAY, group=("site",))


def detect_by_site(spark, sf_dir):
    """The flagship: which sites degraded on the day against the trailing week."""
    return D.detect(measurements(spark, sf_dir), BY_SITE).select("site", "base_n", "day_n", *_shown())


DETECT_SQL = f"{_detect_sql('asn, site')} SELECT CAST(asn AS BIGINT) AS asn, site, base_n, base_ips, day_n, round(df, 4) AS df, {_SHOWN_SQL} FROM f"
_SITE_SQL = f"{_detect_sql('site')} SELECT site, base_n, day_n, {_SHOWN_SQL} FROM f"


def d4_dominance_trim(spark, sf_dir):
    base, _ = D.split_window(measurements(spark, sf_dir), CFG)
    return base.groupBy(F.col("asn").cast("long").alias("asn"), "site").agg(F.count(F.lit(1)).alias("kept"), F.sum("id").alias("ids"), F.countDistinct("ip").alias("ips"))


D5 = ["base_median", "base_p20", "base_median_loss", "base_p95_loss", "base_mean", "base_var", "base_lossy_share", *[f"base_{k}_{r}" for r in RATES for k in ("median", "mean")]]


def d5_baseline_metrics(spark, sf_dir):
    base, _ = D.split_window(measurements(spark, sf_dir), CFG)
    s = D.summary(base, CFG, "base")
    return s.select(F.col("asn").cast("long").alias("asn"), "site", "base_n", "base_ips", *[F.round(c, 6).alias(c) for c in D5], "base_lossy", "base_losses")


def d6_day_metrics(spark, sf_dir):
    _, today = D.split_window(measurements(spark, sf_dir), CFG)
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return today.groupBy(F.col("asn").cast("long").alias("asn"), "site").agg(
        F.count(F.lit(1)).alias("n"), q("rtt", 0.01).alias("p01"), q("rtt", 0.1).alias("p10"), q("rtt", 0.2).alias("p20"), q("rtt", 0.5).alias("p50"), q("rtt", 0.9).alias("p90"), q("rtt", 0.95).alias("p95"),
        q("throughput", 0.5).alias("down50"), q("upload_throughput", 0.5).alias("up50"), q("loss", 0.5).alias("loss50"), q("loss", 0.95).alias("loss95"), F.count("upload_throughput").alias("uploads"),
        F.count_if(F.col("loss") > 0.01).alias("lossy"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"),
    )


D6_SQL = f"""WITH {BASE} SELECT CAST(asn AS BIGINT) AS asn, site, count(*) AS n, round(quantile_cont(rtt, 0.01), 6) AS p01, round(quantile_cont(rtt, 0.1), 6) AS p10, round(quantile_cont(rtt, 0.2), 6) AS p20,
 round(quantile_cont(rtt, 0.5), 6) AS p50, round(quantile_cont(rtt, 0.9), 6) AS p90, round(quantile_cont(rtt, 0.95), 6) AS p95, round(quantile_cont(throughput, 0.5), 6) AS down50, round(quantile_cont(upload_throughput, 0.5), 6) AS up50,
 round(quantile_cont(loss, 0.5), 6) AS loss50, round(quantile_cont(loss, 0.95), 6) AS loss95, count(upload_throughput) AS uploads, count(*) FILTER (loss > 0.01) AS lossy, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM t GROUP BY ALL"""


def d7_anomaly_ratio(spark, sf_dir):
    r = D.anomaly_ratios(measurements(spark, sf_dir), CFG)
    return r.select(F.col("asn").cast("long").alias("asn"), "site", "n", *[F.round(c, 6).alias(c) for c in ("ratio", "ratio_throughput", "ratio_upload_throughput")])


D7_SQL = f"""WITH {BASE}, {_stats('base', 'sb')} SELECT CAST(asn AS BIGINT) AS asn, site, round(nullif(count(*) FILTER (rtt > base_median + 5), 0) / count(rtt), 6) AS ratio, count(*) AS n,
 round(nullif(count(*) FILTER (throughput < base_median_throughput), 0) / count(throughput), 6) AS ratio_throughput,
 round(nullif(count(*) FILTER (upload_throughput < base_median_upload_throughput), 0) / nullif(count(upload_throughput), 0), 6) AS ratio_upload_throughput FROM t JOIN sb USING (asn, site) GROUP BY ALL"""


def d9_roll_up(spark, sf_dir):
    r = D.roll_up(D.detect(measurements(spark, sf_dir), CFG), ["site"])
    whole = ["site", "groups", "anomalous", *FLAGS[1:]]
    return r.select(*whole, *[F.round(c, 6).alias(c) for c in r.columns if c not in whole])


D9_SQL = f"""{_detect_sql('asn, site')} SELECT site, count(*) AS groups, CAST(sum(anomaly_rtt) AS BIGINT) AS anomalous, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in FLAGS[1:])},
 round(avg(day_median - base_median), 6) AS mean_rise, round(max(day_median - base_median), 6) AS most_rise, {', '.join(f'round({f}({c}), 6) AS {n}_change_{r}' for r, c in (('throughput', 'tchange'), ('upload_throughput', 'uchange')) for n, f in (('mean', 'avg'), ('least', 'min')))} FROM f GROUP BY site"""


def d3_consistent_addresses(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ip"), F.col("c_nationkey").cast("long").alias("nk"), F.when(F.col("c_custkey") % 5 == 0, "app").otherwise("ist").alias("client_type"))
    n = nations(spark, sf_dir)
    clients = c.join(n, "nk").select("ip", "client_type", (F.col("rk") % 2).alias("ip_version"), "lon", "lat")
    servers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nk")).distinct().where("nk % 3 = 0").join(n, "nk").select((F.col("rk") % 2).alias("ip_version"), F.col("lon").alias("server_lon"), F.col("lat").alias("server_lat"))
    return D.consistent_addresses(D.client_server_km(clients, servers), within=500.0)


D3_SQL = f"""WITH {N}, c AS (SELECT c_custkey AS ip, CASE WHEN c_custkey % 5 = 0 THEN 'app' ELSE 'ist' END AS client_type, rk % 2 AS ip_version, lon, lat FROM customer JOIN n ON nk = c_nationkey),
s AS (SELECT DISTINCT rk % 2 AS ip_version, lon, lat FROM supplier JOIN n ON nk = s_nationkey WHERE s_nationkey % 3 = 0),
d AS (SELECT c.ip, c.client_type, c.ip_version, min({KM.format(a='c', b='s')}) AS km FROM c JOIN s USING (ip_version) GROUP BY ALL),
l AS (SELECT *, min(km) OVER (PARTITION BY ip_version) AS least FROM d)
SELECT DISTINCT ip, ip_version FROM l WHERE km <= least + 500 OR client_type <> 'ist'"""


def udf_mwu(spark, sf_dir):
    base, today = D.split_window(measurements(spark, sf_dir), CFG)
    r = D.rank_tests(base, today, ["site"], "rtt")
    return r.select("site", *[F.round(f"mwu.{c}", 6).alias(c.lower()) for c in ("U", "Z", "p_value", "meanU", "stdU")])


def udf_wasserstein_distance(spark, sf_dir):
    base, today = D.split_window(measurements(spark, sf_dir), CFG)
    return D.rank_tests(base, today, ["site"], "rtt").select("site", F.round("distance", 6).alias("distance"))


def udf_wasserstein(spark, sf_dir):
    base, today = D.split_window(measurements(spark, sf_dir), CFG)
    a = base.groupBy("site").agg(F.sort_array(F.collect_list("rtt")).alias("a"))
    b = today.groupBy("site").agg(F.sort_array(F.collect_list("rtt")).alias("b"))
    w = stats.wasserstein(F.col("a"), F.col("b"), F.lit(50))
    return a.join(b, "site").select("site", w.alias("w")).select("site", F.round("w.distance", 6).alias("distance"), "w.p_value")


def udf_welch(spark, sf_dir):
    base, today = D.split_window(measurements(spark, sf_dir), CFG)
    g = lambda d, p: d.groupBy("site").agg(F.count("rtt").alias(f"n{p}"), F.avg("rtt").alias(f"m{p}"), F.var_samp("rtt").alias(f"v{p}"))
    w = stats.welch(*[F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")])
    told = g(base, 1).join(g(today, 2), "site").select("site", w.alias("w"))
    return told.select("site", *[F.round(f"w.{c}", 5).alias(c) for c in ("t_stat", "degrees_of_freedom", "mean1", "mean2", "se1", "se2")], F.round(stats.welch_p(F.col("w.t_stat"), F.col("w.degrees_of_freedom")), 6).alias("p_value"))


def udf_loss_z(spark, sf_dir):
    m = measurements(spark, sf_dir)
    s = m.groupBy("site").agg(*[F.count_if((F.col("loss") > 0.05) & (F.col("day") < DAY)).alias("l1"), F.count_if(F.col("day") < DAY).alias("n1"), F.count_if((F.col("loss") > 0.05) & (F.col("day") >= DAY)).alias("l2"), F.count_if(F.col("day") >= DAY).alias("n2")])
    return s.select("site", F.round(stats.loss_z(F.col("l1"), F.col("n1"), F.col("l2"), F.col("n2")), 6).alias("z"))


def udf_fisher(spark, sf_dir):
    m = measurements(spark, sf_dir)
    hit, late = F.col("loss") > 0.09, F.col("day") >= DAY
    s = m.groupBy("site").agg(F.count_if(hit & late).alias("a"), F.count_if(late).alias("b"), F.count_if(hit & ~late).alias("c"), F.count_if(~late).alias("d"))
    return s.select("site", "a", "b", "c", "d", stats.fisher_exact("a", "b", "c", "d").alias("f")).select("site", "a", "b", "c", "d", F.round("f.p", 6).alias("p"), F.round("f.odds", 6).alias("odds"))


FISHER_SQL = f"""WITH {M}, s AS (SELECT site, count(*) FILTER (loss > 0.09 AND day >= DATE '{DAY}') AS a, count(*) FILTER (day >= DATE '{DAY}') AS b, count(*) FILTER (loss > 0.09 AND day < DATE '{DAY}') AS c, count(*) FILTER (day < DATE '{DAY}') AS d FROM m GROUP BY site),
k AS (SELECT *, unnest(generate_series(a, least(b, a + c))) AS k FROM s),
p AS (SELECT site, a, b, c, d, sum(exp(lgamma(b + 1) + lgamma(d + 1) + lgamma(a + c + 1) + lgamma(b + d - a - c + 1) - lgamma(b + d + 1) - lgamma(k + 1) - lgamma(b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a - c + k + 1))) AS p FROM k WHERE d - a - c + k >= 0 GROUP BY ALL)
SELECT site, a, b, c, d, round(least(1.0, p), 6) AS p, round(a * (d - c) / ((b - a) * c), 6) AS odds FROM p"""


def d8_flags(spark, sf_dir):
    return D.detect(measurements(spark, sf_dir), CFG).select(F.col("asn").cast("long").alias("asn"), "site", *FLAGS)


WELCH_SQL = f"""WITH {BASE}, g AS (SELECT site, count(rtt) FILTER (s = 1) AS n1, avg(rtt) FILTER (s = 1) AS m1, var_samp(rtt) FILTER (s = 1) AS v1, count(rtt) FILTER (s = 2) AS n2, avg(rtt) FILTER (s = 2) AS m2, var_samp(rtt) FILTER (s = 2) AS v2
 FROM (SELECT site, rtt, 1 AS s FROM b UNION ALL SELECT site, rtt, 2 FROM t) GROUP BY site),
w AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM g)
SELECT site, round(t, 5) AS t_stat, round(df, 5) AS degrees_of_freedom, round(m1, 5) AS mean1, round(m2, 5) AS mean2, round(sqrt(v1 / n1), 5) AS se1, round(sqrt(v2 / n2), 5) AS se2, round({welch_p_sql('t', 'df')}, 6) AS p_value FROM w"""


QUERIES = {
    "detect_by_site": (detect_by_site, _SITE_SQL),
    "detect_degradation": (detect_degradation, DETECT_SQL),
    "d4_dominance_trim": (d4_dominance_trim, f"WITH {BASE} SELECT CAST(asn AS BIGINT) AS asn, site, count(*) AS kept, CAST(sum(id) AS BIGINT) AS ids, count(DISTINCT ip) AS ips FROM b GROUP BY ALL"),
    "d5_baseline_metrics": (d5_baseline_metrics, f"WITH {BASE}, {_stats('base', 'sb').replace('var_samp(rtt) AS base_var', 'var_samp(rtt) AS base_var, quantile_cont(rtt, 0.2) AS base_p20, quantile_cont(loss, 0.5) AS base_median_loss')} SELECT CAST(asn AS BIGINT) AS asn, site, base_n, base_ips, {', '.join(f'round({c}, 6) AS {c}' for c in D5)}, base_lossy, base_losses FROM sb"),
    "d6_day_metrics": (d6_day_metrics, D6_SQL),
    "d7_anomaly_ratio": (d7_anomaly_ratio, D7_SQL),
    "d9_roll_up": (d9_roll_up, D9_SQL),
    "d3_consistent_addresses": (d3_consistent_addresses, D3_SQL),
    "d8_flags": (d8_flags, f"{_detect_sql('asn, site')} SELECT CAST(asn AS BIGINT) AS asn, site, {', '.join(FLAGS)} FROM f"),
    "udf_mwu": (udf_mwu, f"WITH {BASE}, {RANKS.replace('asn, site, ', 'site, ').replace('asn, site', 'site')} SELECT site, round(u, 6) AS u, round(z, 6) AS z, round(2 * (1 - {cdf('abs(z)')}), 6) AS p_value, round(mu, 6) AS meanu, round(sd, 6) AS stdu FROM rz"),
    "udf_wasserstein_distance": (udf_wasserstein_distance, f"WITH {BASE}, {RANKS.replace('asn, site, ', 'site, ').replace('asn, site', 'site')} SELECT site, round(distance, 6) AS distance FROM rz"),
    "udf_wasserstein": (udf_wasserstein, None),
    "udf_welch": (udf_welch, WELCH_SQL),
    "udf_loss_z": (udf_loss_z, f"WITH {M}, s AS (SELECT site, count(*) FILTER (loss > 0.05 AND day < DATE '{DAY}') AS l1, count(*) FILTER (day < DATE '{DAY}') AS n1, count(*) FILTER (loss > 0.05 AND day >= DATE '{DAY}') AS l2, count(*) FILTER (day >= DATE '{DAY}') AS n2 FROM m GROUP BY site) SELECT site, round((l2 / n2 - l1 / n1) / nullif(sqrt((l1 + l2) / (n1 + n2) * (1 - (l1 + l2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)), 0), 6) AS z FROM s"),
    "udf_fisher": (udf_fisher, FISHER_SQL),
}
