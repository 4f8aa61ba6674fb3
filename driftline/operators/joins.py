"""Joins that Spark has no operator for: nearest in time, longest prefix, metro of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo, ip


def nearest_in_time(rows: DataFrame, key: list[str], day: Column, target: Column, prefer: list[Column] = (), past_first: bool = False) -> DataFrame:
    """One row a key: the one whose date is nearest to the target date.

    Order: ``prefer`` (true first), distance in days, then the past if asked, then the later date, then
    the whole row, so that ties have one answer. Nulls in the date lose.
    """
    gap = F.abs(F.datediff(day, target))
    order = [p.desc_nulls_last() for p in prefer] + [gap.asc_nulls_last()]
    if past_first:
        order.append((day <= target).desc())
    order += [day.desc(), F.to_json(F.struct(*rows.columns))]
    picked = rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return picked.where("__n = 1").drop("__n")


def masks_in(prefixes: DataFrame) -> DataFrame:
    """The prefix lengths that occur at all: at most 33 (129 for IPv6) rows."""
    return prefixes.select("mask").where("mask is not null").distinct()


def longest_prefix_v4(addresses: DataFrame, prefixes: DataFrame, prefer: list[Column] = ()) -> DataFrame:
    """(ip, n, columns of ``prefixes``): the longest prefix that holds each distinct address.

    ``addresses`` has ip and n (number); ``prefixes`` has network (number), mask and payload. Only masks
    that occur are tried, so the join is an equi-join on (network, mask); ties go by ``prefer``.
    """
    tried = addresses.select("ip", "n").where("n is not null").distinct().crossJoin(F.broadcast(masks_in(prefixes)))
    keyed = tried.withColumn("network", ip.mask_v4(F.col("n"), F.col("mask")))
    met = keyed.join(prefixes, ["network", "mask"])
    rank = F.row_number().over(W.partitionBy("ip").orderBy(F.desc("mask"), *prefer))
    return met.withColumn("__n", rank).where("__n = 1").drop("__n")


def longest_prefix_v6(addresses: DataFrame, prefixes: DataFrame, prefer: list[Column] = ()) -> DataFrame:
    """The same for (hi, lo) addresses and (net_hi, net_lo, mask) prefixes."""
    tried = addresses.select("ip", "hi", "lo").where("hi is not null").distinct().crossJoin(F.broadcast(masks_in(prefixes)))
    hi, lo = ip.mask_v6(F.col("hi"), F.col("lo"), F.col("mask"))
    met = tried.withColumns({"net_hi": hi, "net_lo": lo}).join(prefixes, ["net_hi", "net_lo", "mask"])
    rank = F.row_number().over(W.partitionBy("ip").orderBy(F.desc("mask"), *prefer))
    return met.withColumn("__n", rank).where("__n = 1").drop("__n")


def near_seeds(points: DataFrame, seeds: DataFrame, within_km: float, size: float = 5.0) -> DataFrame:
    """Points (lon, lat) joined with the seeds (seed_lon, seed_lat) that can be within ``within_km``, as an
    equi-join on grid cells; the exact distance is for the caller to test.

    A point goes to all cells that its box touches: ``within_km`` in latitude, and as many degrees of
    longitude as that is at the box's edge nearest to a pole (all of them beyond 85 degrees).
    """
    cells, pad = round(360 / size), within_km / 110.0
    low, high = F.greatest(F.col("lat") - pad, F.lit(-90.0)), F.least(F.col("lat") + pad, F.lit(90.0))
    edge = F.greatest(F.abs(low), F.abs(high))
    wide = F.when(edge >= 85, F.lit(180.0)).otherwise(F.least(F.lit(pad) / F.cos(F.radians(F.least(edge, F.lit(85.0)))), F.lit(180.0)))
    column = lambda v: F.floor((v + 180) / size).cast("int")
    row = lambda v: F.floor((v + 90) / size).cast("int")
    across = F.sequence(column(F.col("lon") - wide), F.least(column(F.col("lon") - wide) + cells - 1, column(F.col("lon") + wide)))
    known = points.where("lon is not null and lat is not null")
    boxed = known.withColumn("cx", F.explode(across)).withColumn("cy", F.explode(F.sequence(row(low), row(high)))).withColumn("cx", F.pmod("cx", F.lit(cells)))
    keyed = seeds.where("seed_lon is not null and seed_lat is not null").withColumns({"cx": F.pmod(column(F.col("seed_lon")), F.lit(cells)), "cy": row(F.col("seed_lat"))})
    return boxed.join(keyed, ["cx", "cy"]).drop("cx", "cy")


def metro_of_country(points: DataFrame, seeds: DataFrame, far_km: float = 100.0) -> DataFrame:
    """Distinct (lon, lat, country) with the nearest seed of the country and how it was found:
    country_nearest, country_nearest_far beyond ``far_km``, no_country_cells. Ties go to metro_id."""
    distinct = points.select("lon", "lat", "country").distinct()
    met = distinct.join(seeds, "country", "left").withColumn("km", geo.distance(F.col("lon"), F.col("lat"), F.col("seed_lon"), F.col("seed_lat")))
    best = met.groupBy("lon", "lat", "country").agg(F.min(F.struct(F.col("km").isNull().alias("z"), "km", "metro_id")).alias("b"))
    method = F.when(F.col("b.metro_id").isNull(), "no_country_cells").when(F.col("b.km") > far_km, "country_nearest_far").otherwise("country_nearest")
    return best.select("lon", "lat", "country", F.col("b.metro_id").alias("metro_id"), F.col("b.km").alias("km"), method.alias("method"))


def neighbour_window(rows: DataFrame, key: list[str], day: str, days: int) -> DataFrame:
    """Pairs of a row and the other rows of its key within ``days`` days, as an equi-join on buckets of
    days instead of a nested loop: a row goes to its own bucket, its partners to that and both beside."""
    width = days + 1
    bucket = F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / width)
    left = rows.withColumn("__b", bucket)
    right = rows.select(*[F.col(c).alias(f"other_{c}") for c in rows.columns])
    right = right.withColumn("__b", F.explode(F.array(*[F.floor(F.datediff(F.col(f"other_{day}"), F.lit("1970-01-01").cast("date")) / width) + i for i in (-1, 0, 1)])))
    on = [left["__b"] == right["__b"]] + [left[k] == right[f"other_{k}"] for k in key]
    apart = F.abs(F.datediff(F.col(day), F.col(f"other_{day}")))
    return left.join(right, on).where((apart <= days) & (apart > 0)).drop("__b")
