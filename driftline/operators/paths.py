"""Paths as ordered hops: one node a TTL, dense TTLs, first-occurrence-distinct paths, edges, loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_ttl(hops: DataFrame, order: list) -> DataFrame:
    """One hop for each (id, ttl)."""
    n = F.row_number().over(W.partitionBy("id", "ttl").orderBy(*order))
    return hops.withColumn("__n", n).where("__n = 1").drop("__n")


def dense(hops: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Every TTL from 1 to the path's last; missing hops get ``columns``."""
    ids = hops.groupBy("id").agg(F.max("ttl").alias("last")).where("last >= 1")
    every = ids.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"))).alias("ttl"))
    met = every.join(hops.withColumn("__seen", F.lit(True)), ["id", "ttl"], "left")
    return met.select("id", "ttl", *[F.when(F.col("__seen"), F.col(c)).otherwise(v).alias(c) for c, v in columns.items()])


def ordered_distinct(hops: DataFrame, node: str, by: list[str] = ("id",)) -> DataFrame:
    """(by, path): each node once, ordered by where it occurs first."""
    first = hops.where(F.col(node).isNotNull()).groupBy(*by, node).agg(F.min("ttl").alias("t"))
    path = F.transform(F.array_sort(F.collect_list(F.struct("t", F.col(node).alias("x")))), lambda s: s.x)
    return first.groupBy(*by).agg(path.alias("path"))


def edges(paths: DataFrame, by: list[str] = ("id",)) -> DataFrame:
    """(by, pos, a, b): neighbouring nodes of each path."""
    steps = F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b")))
    long = paths.where(F.size("path") >= 2)
    return long.select(*by, steps.alias("pos", "e")).select(*by, "pos", F.col("e.a").alias("a"), F.col("e.b").alias("b"))


def canonical(a: Column, b: Column, key_a: Column, key_b: Column) -> Column:
    """Edge name independent of direction: the lesser key first, ties keep the direction."""
    return F.when(key_a <= key_b, F.concat(a, F.lit(" - "), b)).otherwise(F.concat(b, F.lit(" - "), a))


def loop_flags(path: Column) -> Column:
    """struct<unresponsive, loop>: -1 anywhere, or a repeated node without a -1."""
    gone = F.exists(path, lambda x: x == -1)
    return F.struct(gone.alias("unresponsive"), ((F.size(path) > F.size(F.array_distinct(path))) & ~gone).alias("loop"))


def trim_dominant(rows: DataFrame, group: list[str], member: str, order: str, share: float = 0.4) -> DataFrame:
    """At most floor(share x group size) rows of one member in a group, those of least ``order``."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__total"))
    n = F.row_number().over(W.partitionBy(*group, member).orderBy(order))
    numbered = rows.withColumn("__n", n).join(sizes, group)
    return numbered.where(F.col("__n") <= F.floor(F.lit(share) * F.col("__total"))).drop("__n", "__total")


def cut_excursions(hops: DataFrame, key: str, suspect: Column) -> DataFrame:
    """Drop suspect hops between two equal known neighbours (A - [B] - A), then everything from the
    first return to a node that was left."""
    w = W.partitionBy("id").orderBy("ttl")
    before = F.last(key, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(key, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    left = hops.withColumns({"__p": before, "__q": after}).where(~F.coalesce(suspect & (F.col("__p") == F.col("__q")) & (F.col(key) != F.col("__p")), F.lit(False)))
    first = F.min("ttl").over(W.partitionBy("id", key))
    prev = F.last(key, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    again = F.col(key).isNotNull() & (F.col("__prev") != F.col(key)) & (F.col("ttl") > F.col("__first"))
    marked = left.withColumns({"__first": first, "__prev": prev})
    stop = F.min(F.when(again, F.col("ttl"))).over(W.partitionBy("id"))
    return marked.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("ttl") < F.col("__stop"))).drop("__p", "__q", "__first", "__prev", "__stop")
