"""Daily runs: resume, missing baseline days, phases with gating per day, one stage over many days, CLI."""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline import schemas
from driftline.operators import paths
from driftline.plans import detect, mapping, publish, tomography, traces
from driftline.sources.io import DAY, Store, missing_baseline

GROUP = ("asn", "label", "site", "ip_version")


FLAGS = ("anomaly_rtt", "anomaly_throughput", "anomaly_upload_throughput", "anomaly_loss")
PAIR = ("asn", "label", "site")


def merge_day(tests: Store, out: Store, day: str, granularity: str = "city") -> None:
    """One day of downloads with the metrics of their uploads (``uploads``: id, rtt, throughput), if the
    input has any."""
    rows = tests.read("tests").where(F.col("day") == F.to_date(F.lit(day))).withColumn(DAY, F.col("day"))
    if tests.exists("uploads"):
        rows = traces.merge_up_down(rows.drop("upload_rtt", "upload_throughput"), tests.read("uploads"), ["id"], ["rtt", "throughput"])
    out.write("merged", rows, [f.name for f in schemas.MERGED.fields])


def detect_day(tests: Store, out: Store, day: str, granularity: str = "city") -> None:
    """The groups of a day with their tests and flags; labels follow the granularity, which is stored
    with them."""
    cfg = detect.Detection(day=day, group=GROUP)
    rows = out.window("merged", day, cfg.days)
    if granularity == "metro":
        rows = rows.where(F.col("label").isNotNull())
    found = detect.detect(rows, cfg).withColumns({"z": F.col("mwu.Z"), "p": F.col("mwu.p_value"), "granularity": F.lit(granularity), DAY: F.to_date(F.lit(day))})
    out.write("anomalies", found, [f.name for f in schemas.ANOMALIES.fields])


def pair_name() -> Column:
    return F.concat(F.col("asn").cast("string"), F.lit(" - "), "label", F.lit(" - "), "site")


def anomalous_pairs(out: Store, day: str) -> DataFrame:
    flagged = reduce(lambda a, b: a | b, [F.col(f) == 1 for f in FLAGS])
    return out.day("anomalies", day).where(flagged).select(*PAIR).distinct()


def paths_day(tests: Store, out: Store, day: str, granularity: str = "city") -> None:
    """Whole traces (``traces``: id, multipath, flow, ttl, addr, name, rtt, link) of the measurements of the
    day and the baseline; the day's are anomalous where their group is."""
    schema = [f.name for f in schemas.PATHS.fields]
    at, rows = F.to_date(F.lit(day)), out.window("merged", day)
    if not tests.exists("traces"):
        return
    rows = rows.join(anomalous_pairs(out, day).withColumn("bad", F.lit(True)), list(PAIR), "left").withColumn("dayof", F.col(DAY) == at)
    rows = rows.select("id", pair_name().alias("pair"), "dayof", (F.coalesce("bad", F.lit(False)) & F.col("dayof")).alias("anomalous"), F.col("ip").alias("dst"), "site", F.col("site").alias("src"))
    ends = rows.select("id", "src", "dst", "site").dropDuplicates(["id"])
    hops = tests.read("traces").join(ends.select("id", "dst"), "id")
    single = hops.where("not multipath")
    best = traces.best_flow(hops.where("multipath").withColumn("reaches", F.col("addr") == F.col("dst")).select("id", "flow", "ttl", "addr", "rtt", "reaches"))
    more = hops.where("multipath").join(best.select("id", "flow", "ttl", "addr"), ["id", "flow", "ttl", "addr"], "left_semi")
    whole = traces.normalise_traces(more.unionByName(single).select("id", "multipath", "ttl", "addr", "name", "rtt", "link"), ends)
    told = whole.join(rows.select("id", "pair", "anomalous", "dayof").dropDuplicates(["id"]), "id").withColumn(DAY, at)
    out.write("paths", told, schema)


def map_day(tests: Store, out: Store, day: str, granularity: str = "city") -> None:
    """Hops with network, exchange, place and the distance checks (``prefixes``, ``exchanges``, ``places``,
    and ``cells`` if there are any)."""
    if not all(tests.exists(x) for x in ("prefixes", "exchanges", "places")):
        return
    cells = tests.read("cells") if tests.exists("cells") else None
    hops = mapping.annotate(out.day("paths", day), tests.read("prefixes"), tests.read("exchanges"), tests.read("places"), cells)
    out.write("mapped", mapping.distances(hops).withColumn(DAY, F.to_date(F.lit(day))), [f.name for f in schemas.MAPPED.fields])


def _path_edges(out: Store, day: str) -> DataFrame:
    """(id, pair, anomalous, dayof, ttl, a, b): neighbouring ``asn-metro`` nodes of every path, each node once."""
    hops = out.day("mapped", day).where("asn is not null and metro is not null")
    hops = hops.withColumn("node", F.concat(F.col("asn").cast("string"), F.lit("-"), "metro"))
    by = ["id", "pair", "anomalous", "dayof"]
    return paths.edges(paths.ordered_distinct(hops, "node", by), by)


def culprits_day(tests: Store, out: Store, day: str, granularity: str = "city") -> None:
    """The cover of the day's anomalous pairs over edges, nodes, networks, metros and exchanges, and the
    statistics of all of these."""
    e = _path_edges(out, day).where("dayof").withColumn("edge", paths.canonical(F.col("a"), F.col("b"), F.col("a"), F.col("b")))
    of = out.day("mapped", day).where("ixp is not null and asn is not null and metro is not null").select(F.concat(F.col("asn").cast("string"), F.lit("-"), "metro").alias("node"), "ixp").distinct()
    nodes = e.select("id", "pair", "anomalous", F.explode(F.array("a", "b")).alias("node")).distinct()
    row = lambda df, gran, c: df.select("id", "pair", F.lit(gran).alias("gran"), c.alias("entity"), "anomalous")
    asn, metro = F.split("node", "-", 2)[0], F.split("node", "-", 2)[1]
    ixps = nodes.join(of, "node")
    uses = [row(e, "edge", F.col("edge")), row(nodes, "node", F.col("node")), row(nodes, "as", asn), row(nodes, "metro", metro), row(ixps, "ixp", F.col("ixp"))]
    kid = lambda df, gran, c: df.select(F.lit(gran).alias("gran"), c.alias("entity"), "node")
    kids = [kid(nodes, "as", asn), kid(nodes, "metro", metro), kid(ixps, "ixp", F.col("ixp"))]
    picks, entities = tomography.mixed_cover(reduce(DataFrame.unionByName, uses).distinct(), reduce(DataFrame.unionByName, kids).distinct())
    names, at = [f.name for f in schemas.CULPRITS.fields], F.to_date(F.lit(day))
    found = out.spark.createDataFrame([tuple(p[n] for n in names[:-1]) for p in picks], T.StructType(schemas.CULPRITS.fields[:-1]))
    out.replace_day("culprits", day, found.withColumn(DAY, at), names)
    out.replace_day("entities", day, entities.withColumn(DAY, at), [f.name for f in schemas.ENTITIES.fields])


def verdicts_day(tests: Store, out: Store, day: str, granularity: str = "city") -> None:
    """Reroute or congestion in place for every pair of the day, and whether a culprit edge agrees."""
    e = _path_edges(out, day).select("id", "pair", "dayof", F.concat("a", F.lit("|"), "b").alias("edge"), "b")
    rtts = out.day("mapped", day).where("asn is not null and metro is not null").select("id", F.concat(F.col("asn").cast("string"), F.lit("-"), "metro").alias("b"), "rtt").where("rtt >= 0")
    rtt = e.join(rtts, ["id", "b"]).groupBy("pair", "edge").agg(F.avg(F.when(~F.col("dayof"), F.col("rtt"))).alias("base_rtt"), F.avg(F.when(F.col("dayof"), F.col("rtt"))).alias("day_rtt"))
    m = out.day("mapped", day).select("id", "pair", "dayof").distinct()
    p = tomography.edge_prevalence(e.select("id", "edge"), m).join(rtt, ["pair", "edge"], "left").withColumn("direction", F.lit("forward"))
    told = tomography.verdicts(p, ["pair"])
    picked = out.day("culprits", day).where("gran = 'edge'").select(F.col("entity").alias("edge")) if out.exists("culprits") else None
    edge = lambda c: F.array_join(F.array_sort(F.split(c, r"\|")), " - ")
    segment = edge(F.coalesce("changed_segment", "congested_segment"))
    told = told.withColumn("edge", segment).join(picked.distinct().withColumn("hit", F.lit(True)), "edge", "left")
    out.replace_day("verdicts", day, told.withColumns({"agrees_with_culprit": F.coalesce("hit", F.lit(False)), DAY: F.to_date(F.lit(day))}), [f.name for f in schemas.VERDICTS.fields])


def publish_day(tests: Store, out: Store, day: str, granularity: str = "city", least_day: int = 10) -> None:
    """Anomalous groups with enough measurements; located at the finest culprit that their paths go through,
    else unresolved."""
    at = F.to_date(F.lit(day))
    groups = publish.public_groups(out.window("merged", day), list(PAIR), at, least_day)
    events = groups.join(anomalous_pairs(out, day), list(PAIR), "left_semi").withColumn("pair", pair_name())
    e = _path_edges(out, day).where("dayof and anomalous").select("pair", paths.canonical(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("edge"), F.explode(F.array("a", "b")).alias("node"))
    asn, metro = F.split("node", "-", 2)[0], F.split("node", "-", 2)[1]
    entity = F.explode(F.array(*[F.struct(F.lit(g).alias("gran"), c.alias("entity")) for g, c in (("edge", F.col("edge")), ("node", F.col("node")), ("as", asn), ("metro", metro))])).alias("x")
    through = e.select("pair", entity).select("pair", "x.gran", "x.entity").distinct().join(out.day("culprits", day).select("gran", "entity", "step"), ["gran", "entity"])
    best = through.groupBy("pair").agg(F.min_by(F.struct("gran", "entity"), F.struct("step", "entity")).alias("c"))
    told = events.join(best, "pair", "left").withColumns({"location": F.coalesce("c.gran", F.lit("unresolved")), "edge": F.col("c.entity"), DAY: at})
    out.replace_day("events", day, told, [f.name for f in schemas.EVENTS.fields])


STAGES = {"merged": merge_day, "anomalies": detect_day, "paths": paths_day, "mapped": map_day, "culprits": culprits_day, "verdicts": verdicts_day, "events": publish_day}


def done(out: Store, stage: str, day: str, granularity: str = "city") -> bool:
    """Whether a stage's partition is there; one of another granularity is refused."""
    if not out.exists(stage) or day not in out.days(stage):
        return False
    if stage == "anomalies":
        kinds = {r[0] for r in out.day(stage, day).select("granularity").distinct().limit(3).collect()} - {None}
        if kinds and kinds != {granularity}:
            raise ValueError(f"{stage} of {day} has granularity {sorted(kinds)}, not {granularity}")
    return True


def run(tests: Store, out: Store, days: list[str], rerun: bool = False, workers: int = 4, granularity: str = "city") -> dict[str, str]:
    """All stages of all days; a day goes on only if its stage before succeeded. Returns what failed.

    Missing baseline days are merged first. Days run beside each other in one session.
    """
    schemas.create_all(out)
    have = [] if rerun else out.days("merged")
    need = sorted({d for day in days for d in [*missing_baseline(have, day), day]})
    failed: dict[str, str] = {}

    def step(stage: str, day: str) -> None:
        try:
            if rerun or not done(out, stage, day, granularity):
                STAGES[stage](tests, out, day, granularity)
        except Exception as e:  # noqa: BLE001
            failed[day] = f"{stage}: {e}"

    for stage in STAGES:
        todo = [d for d in (need if stage == "merged" else days) if d not in failed]
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(lambda d, s=stage: step(s, d), todo))
    return {d: w for d, w in failed.items() if d in days}


def audit(out: Store) -> DataFrame:
    """Merged days of under half their neighbours' volume."""
    volumes = out.read("merged").groupBy(F.col(DAY).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit("merged"))
    return publish.stale_partitions(volumes, ["name"])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Daily detection over a table store")
    p.add_argument("--tests", required=True, help="root with the table `tests`")
    p.add_argument("--out", required=True, help="root of the output tables")
    p.add_argument("--start", required=True)
    p.add_argument("--end")
    p.add_argument("--stage", choices=list(STAGES), help="run this stage alone")
    p.add_argument("--rerun", action="store_true")
    p.add_argument("--delete", action="store_true", help="drop the days' outputs first")
    p.add_argument("--granularity", choices=["city", "metro"], default="city")
    p.add_argument("--workers", type=int, default=4)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("driftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    first, last = dt.date.fromisoformat(a.start), dt.date.fromisoformat(a.end or a.start)
    days = [(first + dt.timedelta(i)).isoformat() for i in range((last - first).days + 1)]
    tests, out = Store(spark, a.tests, read_only=True), Store(spark, a.out)
    if tests.root == out.root:
        p.error("the output root must differ from the input root")
    failed: dict[str, str] = {}
    if a.delete:
        failed |= {x: "not deleted" for x in out.delete_days([x for x in schemas.TABLES if x not in ("merged", "place_metro")], days)}
    if a.stage:
        for day in days:
            try:
                done(out, "anomalies", day, a.granularity)  # refuses a day of another granularity
                STAGES[a.stage](tests, out, day, a.granularity)
            except Exception as e:  # noqa: BLE001
                failed[day] = str(e)
    else:
        failed |= run(tests, out, days, a.rerun, a.workers, a.granularity)
    for day, why in sorted(failed.items()):
        print(f"{day}: {why.splitlines()[0] if why else why}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
