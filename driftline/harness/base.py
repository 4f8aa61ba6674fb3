"""How the harness tables stand in for the pipeline's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

DAY = "2024-01-20"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark, sf_dir):
    """Speed tests from ``events``. On the day rates fall for some groups and one site begins to lose; a quarter
    of the addresses has no upload."""
    k = F.get_json_object("props", "$.k").cast("int")
    late = F.to_date("ts") >= F.lit(DAY).cast("date")
    down = F.when(late & (F.col("user_id") % 10 % 3 == 0), 0.3).otherwise(1.0)
    up = F.when(late & (F.col("event_type") == "click"), 0.5).otherwise(1.0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("day"), F.col("user_id").alias("ip"), F.col("event_type").alias("site"),
        F.col("value").alias("rtt"), F.when(~late & (F.col("event_type") == "error"), k / 10000.0).otherwise(k / 1000.0).alias("loss"), (F.col("user_id") % 10).alias("asn"), "ts",
        ((F.col("value") + 20) * down).alias("throughput"), F.when(F.col("user_id") % 4 != 0, (k + 10) * up).alias("upload_throughput"),
    )


M = f"""m AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, user_id AS ip, event_type AS site, value AS rtt,
 CAST(json_extract_string(props, '$.k') AS INT) / CASE WHEN CAST(ts AS DATE) < DATE '{DAY}' AND event_type = 'error' THEN 10000.0::DOUBLE ELSE 1000.0::DOUBLE END AS loss, user_id % 10 AS asn, ts,
 (value + 20) * CASE WHEN CAST(ts AS DATE) >= DATE '{DAY}' AND user_id % 10 % 3 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS throughput,
 CASE WHEN user_id % 4 <> 0 THEN (CAST(json_extract_string(props, '$.k') AS INT) + 10) * CASE WHEN CAST(ts AS DATE) >= DATE '{DAY}' AND event_type = 'click' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS upload_throughput FROM events)"""


def hops(spark, sf_dir):
    """Traceroute hops from ``lineitem``; (id, ttl) is not unique."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("ttl"), F.col("l_suppkey").alias("node"), F.col("l_quantity").alias("rtt"), F.col("l_partkey").alias("part")
    )


H = "h AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS ttl, l_suppkey AS node, l_quantity AS rtt, l_partkey AS part FROM lineitem)"
H1 = H + ", h1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id, ttl ORDER BY rtt, node, part) = 1)"


def one_per_ttl(spark, sf_dir):
    from driftline.operators.paths import best_per_ttl

    return best_per_ttl(hops(spark, sf_dir), ["rtt", "node", "part"])


def nations(spark, sf_dir):
    """Coordinates for nations: a fixed function of the key."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nk"), F.col("n_regionkey").cast("long").alias("rk"), "n_name",
        (F.col("n_nationkey") * 14.0 - 170).alias("lon"), (F.col("n_nationkey") * 7.0 - 84).alias("lat"),
    )


N = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS nk, CAST(n_regionkey AS BIGINT) AS rk, n_name, n_nationkey * 14.0::DOUBLE - 170 AS lon, n_nationkey * 7.0::DOUBLE - 84 AS lat FROM nation)"
KM = "2 * 6371.0088 * asin(list_transform([pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)], lambda q: CASE WHEN q > 1 THEN 1 ELSE sqrt(q) END)[1])"
ERF = "(sign({x}) * (1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}))))"


def cdf(z: str) -> str:
    x = f"(({z}) / sqrt(2.0))"
    return "(0.5 * (1 + " + ERF.format(x=x, t=f"(1 / (1 + 0.3275911 * abs({x})))") + "))"
