"""Speed-test merge and traceroute preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.paths import best_per_ttl


def merge_up_down(down: DataFrame, up: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Downloads with the metrics of their upload: uploads are collapsed to one row a key (the least
    value of each metric stands for any), null tokens never match."""
    one = up.groupBy(*key).agg(*[F.min(m).alias(f"upload_{m}") for m in metrics])
    return down.join(one, key, "left")


def best_flow(traces: DataFrame) -> DataFrame:
    """The flow of each multipath trace that reaches the destination, then has most answering hops,
    then the greatest TTL, then the least flow id; (id, flow, ttl, addr, rtt, reaches) rows in."""
    hop = traces.groupBy("id", "flow", "ttl", "addr").agg(F.min("rtt").alias("rtt"), F.max("reaches").alias("reaches"))
    flows = hop.groupBy("id", "flow").agg(F.max("reaches").alias("r"), F.count(F.when(F.col("addr") != "*", 1)).alias("n"), F.max("ttl").alias("t"))
    pick = flows.groupBy("id").agg(F.max_by("flow", F.struct("r", "n", "t", -F.col("flow"))).alias("flow"))
    return hop.join(pick, ["id", "flow"])


def normalise(hops: DataFrame) -> DataFrame:
    """One answering node a TTL (least rtt, then address), dense TTLs refilled with '*' and rtt -1."""
    clean = best_per_ttl(hops.where("addr <> '*'"), ["rtt", "addr"])
    last = clean.groupBy("id").agg(F.max("ttl").alias("last"))
    every = last.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"))).alias("ttl"))
    met = every.join(clean.select("id", F.col("ttl").cast("long").alias("ttl"), "addr", "rtt"), ["id", "ttl"], "left")
    return met.select("id", "ttl", F.coalesce("addr", F.lit("*")).alias("addr"), F.coalesce("rtt", F.lit(-1.0)).alias("rtt"))


def prefer_multipath(hops: DataFrame) -> DataFrame:
    """The multipath trace of an id where there is one, else its standard trace; ``multipath`` marks them."""
    best = F.max("multipath").over(W.partitionBy("id"))
    return hops.withColumn("__m", best).where(F.col("multipath") == F.col("__m")).drop("__m")


def normalise_traces(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, ttl, addr, name, rtt, trace_rtt, reach_dest): whole paths from server to destination.

    ``hops`` has (id, multipath, ttl, addr, name, rtt, link), link being the address that a node leads to;
    ``ends`` has (id, src, dst, site). A trace's rtt is that of its last answering TTL (least rtt). If a
    link leads to the destination, that is one hop more, with the trace's rtt. One node a TTL stays (least
    rtt, then address); TTLs without one are ``*`` with rtt -1; the first hop is the server, named by its
    site, at rtt 0. A path reaches its destination if it ends there. Traces without an answer have no row.
    """
    seen = prefer_multipath(hops).where("addr <> '*' and ttl is not null").join(ends, "id")
    late = F.struct(F.col("ttl").alias("t"), (-F.coalesce("rtt", F.lit(float("inf")))).alias("r"))
    whole = seen.groupBy("id", "src", "dst", "site").agg(F.max("ttl").cast("long").alias("last"), F.max_by("rtt", late).alias("trace_rtt"), F.max(F.coalesce(F.col("link") == F.col("dst"), F.lit(False))).alias("led"))
    end = F.col("last") + F.col("led").cast("long")
    every = whole.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(end, F.lit(1).cast("long")))).alias("ttl"))
    one = best_per_ttl(seen.select("id", F.col("ttl").cast("long").alias("ttl"), "addr", "name", "rtt"), [F.col("rtt").asc_nulls_last(), "addr"])
    met = every.join(one, ["id", "ttl"], "left")
    first, added = F.col("ttl") == 1, F.col("led") & (F.col("ttl") == F.col("last") + 1)
    addr = F.when(first, F.col("src")).when(added, F.col("dst")).otherwise(F.coalesce("addr", F.lit("*")))
    name = F.when(first, F.col("site")).otherwise(F.coalesce("name", F.lit("*")))
    rtt = F.when(first, 0.0).when(added, F.coalesce("trace_rtt", F.lit(-1.0))).otherwise(F.coalesce("rtt", F.lit(-1.0)))
    told = met.select("id", "ttl", addr.alias("addr"), name.alias("name"), rtt.alias("rtt"), "trace_rtt", "dst")
    reaches = F.max_by(F.col("addr") == F.col("dst"), "ttl").over(W.partitionBy("id"))
    return told.withColumn("reach_dest", F.coalesce(reaches, F.lit(False))).drop("dst")


def pick_reverse(traces: DataFrame) -> DataFrame:
    """One reverse trace an id: one that REACHES first, then the latest, then the greatest key."""
    w = W.partitionBy("id").orderBy((F.col("stop_reason") == "REACHES").desc_nulls_last(), F.desc("date"), F.desc("key"))
    return traces.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def attach(traces: DataFrame, groups: DataFrame, key: list[str], always) -> DataFrame:
    """Traces of anomalous groups, and those of ``always``; ``matched`` says which."""
    met = traces.join(groups.select(*key).distinct().withColumn("matched", F.lit(True)), key, "left")
    return met.where(F.col("matched") | always).withColumn("matched", F.coalesce("matched", F.lit(False)))
