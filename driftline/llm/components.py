"""Connected components by alternating large-star and small-star steps, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    """Every vertex hands its greater neighbours to the least of itself and its neighbours."""
    turn = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    both = e.select(F.explode(F.array(F.struct("u", "v"), turn)).alias("e")).select("e.u", "e.v")
    # cut, so that Spark can split the neighbours of one vertex in the join
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every vertex hands itself and its lesser neighbours to the least of them."""
    least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
    return e.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (u, v) that is not its component's least vertex.

    Each round takes a constant number of shuffles; rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not now[0] or now == mark:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = now
        e = cut(_small_star(_large_star(e).distinct()).distinct())
