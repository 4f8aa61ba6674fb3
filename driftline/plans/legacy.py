"""Older rules, the source metro, and the cost of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.compat import drop_last_parts


def legacy_loss_flag(median_loss: Column) -> Column:
    """The older flag: median loss alone."""
    return F.coalesce(median_loss > 0.05, F.lit(False)).cast("int")


def legacy_best_node(hops: DataFrame) -> DataFrame:
    """The older path rule: over all traces of a pair the most frequent node at each TTL (ties: lesser)."""
    n = hops.groupBy("pair", "ttl", "node").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("pair", "ttl").orderBy(F.desc("n"), "node")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("pair", "ttl", "node")


def source_metro(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Events with the metro of their client's coordinates and its city part; a lookup per distinct point."""
    met = events.join(resolved.select("lon", "lat", F.col("metro_id").alias("src_metro")), ["lon", "lat"], "left")
    return met.withColumn("src_metro_city", drop_last_parts(F.col("src_metro")))


def cost(spark: SparkSession, log: str, price_per_tib: float = 6.25, top: int = 10) -> DataFrame:
    """(query, bytes, usd): bytes read by each query of a Spark event log, dearest first, at a price per TiB."""
    schema = (
        "Event string, executionId long, description string, `Stage IDs` array<long>, `Stage ID` long, Properties map<string, string>, "
        "`Task Metrics` struct<`Input Metrics`: struct<`Bytes Read`: long>>"
    )
    e = spark.read.schema(schema).json(log)
    kind = F.element_at(F.split("Event", r"\."), -1)
    names = e.where(kind == "SparkListenerSQLExecutionStart").groupBy(F.col("executionId").alias("run")).agg(F.min(F.substring("description", 1, 80)).alias("name"))
    run = F.col("Properties")["spark.sql.execution.id"].try_cast("long")
    stages = e.where(kind == "SparkListenerJobStart").select(run.alias("run"), F.explode("Stage IDs").alias("stage")).where("run is not null")
    stages = stages.groupBy("stage").agg(F.max("run").alias("run"))
    read = e.where(kind == "SparkListenerTaskEnd").groupBy(F.col("Stage ID").alias("stage")).agg(F.sum(F.col("Task Metrics")["Input Metrics"]["Bytes Read"]).alias("n"))
    total = read.join(stages, "stage").groupBy("run").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))
    told = total.join(names, "run", "left").select(F.coalesce("name", F.col("run").cast("string")).alias("query"), "bytes", (F.col("bytes") / F.lit(2.0**40) * price_per_tib).alias("usd"))
    return told.orderBy(F.desc("bytes"), "query").limit(top)
