"""Public events, their view, and the audits of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.functions.compat import drop_last_parts, strip_suffix
from driftline.operators.joins import neighbour_window


def public_groups(rows: DataFrame, keys: list[str], day: Column, least_day: int = 10) -> DataFrame:
    """Groups with at least ``least_day`` measurements on the day: counts of the day and the baseline in
    one pass, extents of the day's metrics. The day is that of the measurement, not of the partition."""
    on = F.col("day") == day
    told = rows.groupBy(*keys).agg(
        F.count_if(on).alias("n_dayof"), F.count_if(~on).alias("n_baseline"), F.avg(F.when(on, F.col("rtt"))).alias("rtt_day"),
        F.avg(F.when(~on, F.col("rtt"))).alias("rtt_base"), F.max(F.when(on, F.col("rtt"))).alias("rtt_most"),
    )
    return told.where(F.col("n_dayof") >= least_day)


def resolved(groups: DataFrame, culprits: DataFrame, pair: list[str], meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with a culprit edge whose both ends have metadata, and groups without any culprit.

    A culprit without metadata drops its groups from both, as in the source pipeline; see
    ``silently_dropped``."""
    ends = culprits.join(meta.select(F.col("asn").alias("from_asn"), F.col("name").alias("from_name")), "from_asn")
    ends = ends.join(meta.select(F.col("asn").alias("to_asn"), F.col("name").alias("to_name")), "to_asn")
    return groups.join(ends, pair), groups.join(culprits.select(*pair).distinct(), pair, "left_anti")


def silently_dropped(groups: DataFrame, culprits: DataFrame, pair: list[str], meta: DataFrame) -> DataFrame:
    yes, no = resolved(groups, culprits, pair, meta)
    return groups.select(*pair).distinct().join(yes.select(*pair), pair, "left_anti").join(no.select(*pair), pair, "left_anti")


def source_override(events: DataFrame, source: str, site: str, anomalous: Column, least_sites: int = 2, share: float = 0.75) -> DataFrame:
    """Location ``source`` where a client network is anomalous towards most of several sites."""
    per = events.groupBy(source).agg(F.countDistinct(site).alias("sites"), F.countDistinct(F.when(anomalous, F.col(site))).alias("bad"))
    wide = per.select(source, ((F.col("sites") >= least_sites) & (F.col("bad") >= share * F.col("sites"))).alias("at_source"))
    return events.join(wide, source).withColumn("location", F.when(F.col("at_source"), "source").otherwise(F.col("location"))).drop("at_source")


def display_city(label: Column, state: Column, country: Column) -> Column:
    """City of a ``City-State-CC`` label: the exact suffix if it is there, else without two parts."""
    suffix = F.concat(F.lit("-"), state, F.lit("-"), country)
    return F.when(F.endswith(label, suffix), strip_suffix(label, suffix)).otherwise(drop_last_parts(label))


def hop_view(hops: DataFrame) -> DataFrame:
    """Per id the hops in ascending TTL with distances accumulated anew from the absolute differences of
    the stored cumulative ones, and the path's summary."""
    w = W.partitionBy("id").orderBy("ttl")
    step = F.abs(F.coalesce(F.col("cum_km") - F.lag("cum_km").over(w), F.col("cum_km")))
    told = hops.withColumn("step", step).withColumn("km", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = F.array_sort(F.collect_list(F.struct("ttl", "node", "rtt", "km")))
    return told.groupBy("id").agg(s.alias("hops"), F.max("km").alias("path_km"), F.count(F.lit(1)).alias("n_hops"), F.countDistinct("node").alias("n_nodes"))


def event_view(events: DataFrame, paths: DataFrame, straight_km: Column) -> DataFrame:
    """Nested public view: client, server, performance, server_to_client_path, quality."""
    met = events.join(paths, "id", "left")
    return met.select(
        "id", F.struct("asn", "client_metro").alias("client"), F.struct("site").alias("server"),
        F.struct(F.struct(F.col("rtt_base").alias("rtt")).alias("baseline"), F.struct(F.col("rtt_day").alias("rtt")).alias("anomaly")).alias("performance"),
        F.struct("hops", "path_km", geo.detour(F.col("path_km"), straight_km).alias("detour")).alias("server_to_client_path"),
        F.struct((F.coalesce("n_hops", F.lit(0)) > 0).alias("has_path")).alias("quality"),
    )


def stale_partitions(volumes: DataFrame, key: list[str], share: float = 0.5, days: int = 7) -> DataFrame:
    """Days whose volume is under ``share`` of the median of their neighbours within ``days`` days."""
    met = neighbour_window(volumes, key, "day", days).groupBy(*key, "day", "n").agg(F.percentile("other_n", F.lit(0.5)).alias("median"))
    return met.withColumn("ratio", F.try_divide("n", "median")).where(F.col("ratio") < share)


def missing_days(present: DataFrame, first: str, last: str) -> DataFrame:
    every = present.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return every.join(present.select("day").distinct(), "day", "left_anti")


def unattributed(events: DataFrame) -> DataFrame:
    """Days on which no event has a culprit."""
    return events.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("culprit").isNotNull()).alias("c")).where("c = 0").select("day", "n")


def contract_violations(events: DataFrame, known_labels: DataFrame) -> DataFrame:
    """Group-identity checks, each with how many rows break it (0 is right)."""
    orphan = events.join(known_labels.select("label").distinct(), "label", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_label").alias("name"), "n")
    empty = events.agg(F.count_if(F.col("label").isNull() | (F.trim("label") == "")).alias("n")).select(F.lit("empty_label").alias("name"), "n")
    twice = events.groupBy("id", "label").agg(F.count(F.lit(1)).alias("m")).where("m > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_event").alias("name"), "n")
    return orphan.unionByName(empty).unionByName(twice)
