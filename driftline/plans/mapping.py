"""Hop mapping: annotation cascades, distances along a path, checks, reverse-path flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo, ip
from driftline.operators import geometry, joins

#: Fibre carries about 200 km a millisecond.
KM_PER_MS = 200.0


def coordinates(private: Column, ttl: Column, server: Column, *sources: Column) -> Column:
    """Null for private hops, the server's for the first, else the first known source."""
    return F.when(private, F.lit(None)).when(ttl == 1, server).otherwise(F.coalesce(*sources))


def distances(hops: DataFrame, baseline_rtt: Column | None = None) -> DataFrame:
    """(id, ttl, lon, lat, rtt) with filled coordinates, hop and cumulative distance and rtt checks.

    A hop's distance needs its own coordinates; missing ones are filled forward. The least possible rtt
    is the cumulative distance and the way back to the first hop at the speed of fibre.
    """
    w = W.partitionBy("id").orderBy("ttl")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    filled = hops.withColumns({"flon": F.last("lon", True).over(run), "flat": F.last("lat", True).over(run)})
    filled = filled.withColumns({"plon": F.lag("flon").over(w), "plat": F.lag("flat").over(w), "slon": F.first("flon", True).over(run), "slat": F.first("flat", True).over(run)})
    hop_km = F.when(F.col("lon").isNotNull(), geo.distance(F.col("plon"), F.col("plat"), F.col("lon"), F.col("lat")))
    told = filled.withColumn("hop_km", hop_km)
    told = told.withColumn("path_km", F.sum(F.coalesce("hop_km", F.lit(0.0))).over(run))
    least = (F.col("path_km") + F.coalesce(geo.distance(F.col("flon"), F.col("flat"), F.col("slon"), F.col("slat")), F.lit(0.0))) / KM_PER_MS
    told = told.withColumn("least_rtt", least).withColumn("bound", F.when(F.col("rtt") >= F.col("least_rtt"), "Above threshold").otherwise("Below threshold"))
    rising = F.when(F.col("rtt") + 3 > F.lag("rtt").over(w), "Increasing").otherwise("Decreasing")
    told = told.withColumn("trend", rising)
    if baseline_rtt is not None:
        told = told.withColumn("against", F.when(F.col("rtt") > baseline_rtt, "Above baseline").otherwise("Within baseline"))
    return told.drop("plon", "plat", "slon", "slat")


def reverse_distances(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """Checks of reverse paths, which are followed from the greatest TTL down: (id, ttl, hop_km, path_km,
    to_end_km, least_rtt, bound, against, trend) added to the hops (id, ttl, lon, lat, rtt).

    ``ends`` has (id, end_lon, end_lat, baseline_rtt). Missing coordinates are filled from the hops before
    on the way; a step without both ends is 0. The distance to the end, and what follows from it, needs
    the hop's own coordinates. A hop whose least possible rtt exceeds its rtt is above the threshold.
    """
    down = W.partitionBy("id").orderBy(F.desc("ttl"))
    run = down.rowsBetween(W.unboundedPreceding, 0)
    told = hops.withColumns({"flon": F.last("lon", True).over(run), "flat": F.last("lat", True).over(run)})
    step = geo.distance(F.lag("flon").over(down), F.lag("flat").over(down), F.col("flon"), F.col("flat"))
    told = told.withColumn("hop_km", F.coalesce(step, F.lit(0.0)))
    told = told.withColumns({"path_km": F.sum("hop_km").over(run), "before": F.lag("rtt").over(W.partitionBy("id").orderBy("ttl"))}).join(ends, "id", "left")
    own = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    told = told.withColumn("to_end_km", F.when(own, geo.distance(F.col("lon"), F.col("lat"), F.col("end_lon"), F.col("end_lat"))))
    told = told.withColumn("least_rtt", (F.col("path_km") + F.col("to_end_km")) / KM_PER_MS)
    silent = F.when(F.col("rtt").isNull(), "Not responsive")
    return told.withColumns({
        "bound": F.when(F.col("least_rtt").isNotNull(), F.when(F.col("least_rtt") > F.col("rtt"), "Above threshold").otherwise("Below threshold")),
        "against": silent.when(F.col("rtt") > F.col("baseline_rtt"), "Above baseline").otherwise("Within baseline"),
        "trend": silent.when(F.col("rtt") + 3 > F.col("before"), "Increasing").otherwise("Stable/Decreasing"),
    }).drop("flon", "flat", "before", "end_lon", "end_lat", "baseline_rtt")


def annotate(hops: DataFrame, prefixes: DataFrame, exchanges: DataFrame, places: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Hops (id, ttl, addr, rtt, ..) with asn, ixp, lon, lat, metro of their address (IPv4).

    The network is that of the exchange's member list (``exchanges``: ip, asn, name), else of the longest
    announced prefix (``prefixes``: network, mask, asn); private addresses have none. Coordinates and
    metro are those of ``places`` (ip, lon, lat, metro; the least row of an address); where ``cells``
    are given (see ``geometry.assign``), the metro is that of the cell at the coordinates, if any. Every
    distinct address and point is looked up once.
    """
    distinct = hops.select(F.col("addr").alias("ip")).where("addr <> '*'").distinct()
    known = distinct.withColumn("n", ip.parse_v4(F.col("ip"))).where("n is not null").where(~ip.private_v4(F.col("n")))
    origin = joins.longest_prefix_v4(known, prefixes, [F.col("asn")]).select("ip", F.col("asn").alias("p_asn"))
    member = exchanges.groupBy("ip").agg(F.min(F.struct("asn", "name")).alias("x")).select("ip", F.col("x.asn").alias("x_asn"), F.col("x.name").alias("ixp"))
    place = places.groupBy("ip").agg(F.min(F.struct("lon", "lat", "metro")).alias("p")).select("ip", "p.lon", "p.lat", "p.metro")
    told = known.select("ip").join(origin, "ip", "left").join(member, "ip", "left").join(place, "ip", "left")
    if cells is not None:
        at = geometry.assign(told, cells).select("lon", "lat", F.col("metro_id").alias("cell"))
        told = told.join(at, ["lon", "lat"], "left").withColumn("metro", F.coalesce("cell", "metro")).drop("cell")
    told = told.select(F.col("ip").alias("addr"), F.coalesce("x_asn", "p_asn").alias("asn"), "ixp", "lon", "lat", "metro")
    return hops.join(told, "addr", "left")


def any_in_path(hops: DataFrame, flag: Column) -> DataFrame:
    """Whether any hop of the path is flagged (forward paths)."""
    return hops.withColumn("any_", F.max(F.coalesce(flag, F.lit(False))).over(W.partitionBy("id")))


def so_far(hops: DataFrame, flag: Column) -> DataFrame:
    """Whether a hop up to this one is flagged (reverse paths)."""
    run = W.partitionBy("id").orderBy("ttl").rowsBetween(W.unboundedPreceding, 0)
    return hops.withColumn("so_far", F.count(F.when(flag, 1)).over(run) > 0)


def path_distance(hops: DataFrame, straight: DataFrame) -> DataFrame:
    """Path length of each id: the last cumulative distance and the way from the last known point to the
    client; the straight line (id, km, lon, lat of the client) if no point is known."""
    told = hops.groupBy("id").agg(F.max_by("path_km", "ttl").alias("path_km"), F.max_by(F.struct("lon", "lat"), F.when(F.col("lon").isNotNull(), F.col("ttl"))).alias("p"))
    met = straight.join(told, "id", "left")
    rest = geo.distance(F.col("p.lon"), F.col("p.lat"), F.col("client_lon"), F.col("client_lat"))
    return met.select("id", F.coalesce(F.col("path_km") + rest, F.col("km")).alias("km"))


def asymmetric(hops: DataFrame, types: list[int]) -> DataFrame:
    """Ids with a hop of ``types`` whose previous known owner differs, and with an rtt jump of over 50
    above all hops of other types."""
    w = W.partitionBy("id").orderBy("ttl").rowsBetween(W.unboundedPreceding, -1)
    seen = hops.withColumn("prev", F.last("owner", True).over(w))
    crossing = F.col("kind").isin(types) & (F.col("owner") != F.col("prev"))
    other = F.max(F.when(F.col("kind") != 4, F.col("rtt")))
    return seen.groupBy("id").agg(F.coalesce(F.max(crossing), F.lit(False)).alias("interdomain"), F.coalesce(F.max(F.when(F.col("kind") == 4, F.col("rtt"))) - other > 50, F.lit(False)).alias("fishy"))


def candidate_addresses(rows: DataFrame, known: DataFrame, day: Column, days: int = 30, private: str = r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)") -> DataFrame:
    """Distinct public addresses without a usable entry of the last ``days`` days; entries without
    coordinates do not count."""
    usable = known.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("ip").agg(F.max("day").alias("seen"))
    fresh = usable.where(F.datediff(day, "seen") <= days).select("ip")
    return rows.select("ip").where(~F.col("ip").rlike(private)).distinct().join(fresh, "ip", "left_anti")


def geo_label(city: Column, region: Column, country: Column) -> Column:
    """``city-region-country``, ``city-country``, or null without city or country."""
    return F.when(city.isNull() | country.isNull(), F.lit(None)).when(region.isNull(), F.concat(city, F.lit("-"), country)).otherwise(F.concat(city, F.lit("-"), region, F.lit("-"), country))
