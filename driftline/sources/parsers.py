"""Parsers of the enrichment inputs, as DataFrames of text lines or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATA = T.StructType().add("answers", T.ArrayType(T.StructType().add("type", T.StringType()).add("answer", T.StringType())))
_RESULT = T.StructType().add("status", T.StringType()).add("timestamp", T.StringType()).add("data", _DATA)
RDNS = T.StructType().add("name", T.StringType()).add("results", T.StructType().add("PTR", _RESULT)).add("status", T.StringType()).add("timestamp", T.StringType()).add("data", _DATA)


def rdns(lines: DataFrame) -> DataFrame:
    """(ip, hostname, timestamp) of reverse-lookup NDJSON lines ``value``; the answer may be nested under
    results.PTR or at the top. Other states than NOERROR and other records than PTR have no hostname."""
    r = lines.select(F.from_json("value", RDNS).alias("r"))
    got = r.select(
        F.col("r.name").alias("ip"), F.coalesce("r.results.PTR.status", "r.status").alias("status"),
        F.coalesce("r.results.PTR.timestamp", "r.timestamp").alias("timestamp"), F.coalesce("r.results.PTR.data", "r.data").alias("data"),
    )
    ptr = F.filter(F.col("data.answers"), lambda a: a.type == "PTR")
    hostname = F.when(F.col("status") == "NOERROR", F.get(ptr, 0).getField("answer"))
    return got.where("ip is not null").select("ip", hostname.alias("hostname"), F.to_timestamp("timestamp").alias("timestamp"))


def geo_csv(lines: DataFrame, least_score: float = 0.0) -> DataFrame:
    """(ip, city, country, lat, lon, score) of header-less lines ``value`` with ``file_date`` and
    ``line_no``, by comma or tab: ip, _, city, state, country, country code, lat, lon, score, ....

    "Washington," keeps its comma; per address the first city and the last coordinates count.
    """
    text = F.replace(F.col("value"), F.lit("Washington, D.C."), F.lit("Washington D.C."))
    cells = F.when(F.col("value").contains("\t"), F.split(text, "\t")).otherwise(F.split(text, ","))
    rows = lines.select("file_date", "line_no", cells.alias("c")).where(F.size("c") >= 10)
    rows = rows.select("file_date", "line_no", *[F.trim(F.col("c")[i]).alias(n) for i, n in ((0, "ip"), (2, "city"), (5, "country"))], *[F.col("c")[i].try_cast("double").alias(n) for i, n in ((6, "lat"), (7, "lon"), (8, "score"))])
    rows = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.coalesce("score", F.lit(0.0)) >= least_score))
    at = F.struct("file_date", "line_no")
    return rows.groupBy("ip").agg(F.min_by("city", at).alias("city"), F.min_by("country", at).alias("country"), F.max_by(F.struct("lat", "lon", "score"), at).alias("p")).select("ip", "city", "country", "p.lat", "p.lon", "p.score")


def prefix_origins(lines: DataFrame) -> DataFrame:
    """(prefix, mask, asn) of ``prefix TAB mask TAB origins`` lines: the first origin, no private ASN."""
    c = F.split("value", "\t")
    asn = F.regexp_extract(F.get(c, 2), r"^(\d+)", 1).try_cast("long")
    rows = lines.select(F.get(c, 0).alias("prefix"), F.get(c, 1).try_cast("int").alias("mask"), asn.alias("asn"))
    return rows.where("asn is not null and mask is not null and not (asn between 64512 and 65534) and asn < 4200000000")


def exchange_members(lines: DataFrame) -> DataFrame:
    """(ip, asn, name) of ``ip TAB asn TAB name`` lines; comments and other widths are skipped."""
    c = F.split("value", "\t")
    good = lines.where(~F.col("value").startswith("#") & (F.size(c) == 3))
    return good.select(c[0].alias("ip"), c[1].try_cast("long").alias("asn"), F.trim(c[2]).alias("name")).where("asn is not null")


def eyeballs(spark: SparkSession, path: str) -> DataFrame:
    """(asn, name, users) from a CSV whose header is its second line: ``AS123`` numbers, values as lists."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    cells = lines.where("n >= 2").select(F.from_csv("value", "rank INT, asn STRING, name STRING, cc STRING, users BIGINT").alias("c")).select("c.*")
    asn = F.regexp_extract("asn", r"^AS(\d+)$", 1).try_cast("long")
    return cells.select(asn.alias("asn"), "name", "users").where("asn is not null").groupBy("asn", "name").agg(F.sort_array(F.collect_list("users")).alias("users"))


def as_metadata(caida: DataFrame, population: DataFrame, facilities: DataFrame, names: DataFrame) -> DataFrame:
    """AS records with population and facilities (arrays) and registered name added; absent ones are empty."""
    met = caida.join(population, "asn", "left").join(facilities, "asn", "left").join(names, "asn", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(met.schema[c].dataType))
    return met.withColumns({"population": empty("population"), "facilities": empty("facilities"), "registered_name": F.coalesce("registered_name", F.lit(""))})


def network_records(spark: SparkSession, path: str) -> DataFrame:
    """(asn, name, organization) of NDJSON network records; lines without a number are skipped."""
    rows = spark.read.schema("asn string, asnName string, organization struct<orgName: string>").json(path)
    return rows.select(F.col("asn").try_cast("long").alias("asn"), F.col("asnName").alias("name"), F.col("organization.orgName").alias("organization")).where("asn is not null")


def exchange_files(spark: SparkSession, path: str) -> DataFrame:
    """``exchange_members`` of files, with the date in each file's name (null without one)."""
    lines = spark.read.text(path).select("value", F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")).alias("date"))
    c = F.split("value", "\t")
    good = lines.where(~F.col("value").startswith("#") & (F.size(c) == 3))
    return good.select(c[0].alias("ip"), c[1].try_cast("long").alias("asn"), F.trim(c[2]).alias("name"), "date").where("asn is not null")


def uploads_by_token(rows: DataFrame, day: str, name: str = "access_token") -> DataFrame:
    """One day's raw uploads with each ``token`` of their client metadata (``raw.Upload.ClientMetadata``, a
    list of Name and Value); rows without one are left out. The day prunes partitions."""
    kept = rows.where(F.col("date") == F.lit(day).cast("date"))
    tokens = F.filter(F.col("raw.Upload.ClientMetadata"), lambda m: m["Name"] == name)
    return kept.withColumn("m", F.explode(tokens)).withColumn("token", F.col("m.Value")).drop("m")


def downloads(rows: DataFrame, day: str) -> DataFrame:
    """One day's raw rows that hold a download."""
    return rows.where((F.col("date") == F.lit(day).cast("date")) & F.col("raw.Download").isNotNull())


def annotation_window(rows: DataFrame, day: str, months: int = 1) -> DataFrame:
    """Hop annotations of the months up to the day, the day included."""
    end = F.lit(day).cast("date")
    return rows.where(F.col("date").between(F.add_months(end, -months), end))


def hostname_key(host):
    """How host names are compared: trimmed, lower case, no final dot."""
    return F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")


def uncached(hosts: DataFrame, cache: DataFrame) -> DataFrame:
    """Host names that the cache does not know."""
    known = cache.select(hostname_key(F.col("hostname")).alias("k")).distinct()
    return hosts.withColumn("k", hostname_key(F.col("hostname"))).join(known, "k", "left_anti").drop("k")
