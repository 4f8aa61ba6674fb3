"""Detection: which groups degraded on a day against their trailing baseline.

Measurements are rows (id, day, ip, <group columns>, metrics). The baseline is the ``days`` days before the
day, without the rows of dominant addresses; today's rows are all kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo, stats
from driftline.functions.compat import over, strict_greatest
from driftline.operators.lineage import settle
from driftline.operators.paths import trim_dominant


@dataclass(frozen=True)
class Detection:
    """What is compared and when it counts: ``rates`` are metrics of which less is worse (those that the
    rows lack are left out)."""

    day: str
    group: tuple[str, ...] = ("asn", "site")
    days: int = 7
    share: float = 0.4
    least_samples: int = 2
    rtt_rise: float = 5.0
    drop: float = -0.20
    p: float = 0.05
    lossy: float = 0.01
    lossy_samples: int = 5
    z: float = 1.645
    rates: tuple[str, ...] = ("throughput", "upload_throughput")
    permutations: int = 50


def consistent_addresses(rows: DataFrame, by: str = "ip_version", km: str = "km", within: float = 25.0, ranks: Column | None = None) -> DataFrame:
    """Distinct addresses whose distance is within ``within`` of the least of their version, or whose
    client type is another one than ``ist``; ``ranks`` restricts the former."""
    least = rows.groupBy(by).agg(F.min(km).alias("least"))
    met = rows.join(F.broadcast(least), by)  # one row a version
    near = F.col(km) <= F.col("least") + within
    near = near & ranks if ranks is not None else near
    return met.where(near | (F.col("client_type") != "ist")).select("ip", by).distinct()


def client_server_km(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Least distance of each client to a server of its version; servers are few sites."""
    met = clients.join(servers, "ip_version")
    km = geo.distance(F.col("lon"), F.col("lat"), F.col("server_lon"), F.col("server_lat"))
    return met.groupBy(*clients.columns).agg(F.min(km).alias("km"))


def split_window(rows: DataFrame, cfg: Detection) -> tuple[DataFrame, DataFrame]:
    day = F.to_date(F.lit(cfg.day))
    before = rows.where((F.col("day") >= F.date_sub(day, cfg.days)) & (F.col("day") < day))
    return trim_dominant(before, list(cfg.group), "ip", "id", cfg.share), rows.where(F.col("day") == day)


def rates_of(rows: DataFrame, cfg: Detection) -> list[str]:
    return [r for r in cfg.rates if r in rows.columns]


def summary(rows: DataFrame, cfg: Detection, prefix: str) -> DataFrame:
    """Size, exact quantiles, mean and spread of rtt, loss and the rates, and the lossy share, of each
    group."""
    lossy = F.count_if(F.col("loss") > cfg.lossy)
    return rows.groupBy(*cfg.group).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"),
        F.countDistinct("ip").alias(f"{prefix}_ips"),
        F.percentile("rtt", F.lit(0.5)).alias(f"{prefix}_median"),
        F.percentile("rtt", F.lit(0.2)).alias(f"{prefix}_p20"),
        F.avg("rtt").alias(f"{prefix}_mean"),
        F.var_samp("rtt").alias(f"{prefix}_var"),
        F.percentile("loss", F.lit(0.5)).alias(f"{prefix}_median_loss"),
        F.percentile("loss", F.lit(0.95)).alias(f"{prefix}_p95_loss"),
        F.count("loss").alias(f"{prefix}_losses"),
        lossy.alias(f"{prefix}_lossy"),
        F.try_divide(lossy, F.count("loss")).alias(f"{prefix}_lossy_share"),
        *[f(F.col(r)).alias(f"{prefix}_{n}_{r}") for r in rates_of(rows, cfg) for n, f in (("median", lambda c: F.percentile(c, F.lit(0.5))), ("mean", F.avg))],
    )


def pooled(base: DataFrame, today: DataFrame, group: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(group, metric, id, x, a, b): the known values of all metrics of both sides, one row each; a marks
    the baseline and b the day. Rows without ids serve all tests but that of permutations."""
    ids = ["id"] if "id" in base.columns else []
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("x")) for n, c in metrics.items()])).alias("m")
    sides = [d.select(*group, *ids, each, F.lit(a).alias("a"), F.lit(1 - a).alias("b")) for d, a in ((base, 1), (today, 0))]
    return sides[0].unionByName(sides[1]).select(*group, "m.metric", *ids, "m.x", "a", "b").where("x is not null")


def compare(pool: DataFrame, keys: list[str], parts: int = 32) -> DataFrame:
    """(keys, mwu struct, welch struct, distance) of the two sides of every key, natively.

    Values are counted first, so ties shuffle once. The values of a key are dealt to ``parts`` ranges by
    approximate quantiles; mid-ranks and both distribution functions are windows inside a range plus
    the sums of the ranges before it, so a key with very many values is not one task.
    """
    counted = pool.groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    whole = counted.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("x", at, 1000)).alias("q"), F.sum("a").cast("double").alias("n1"), F.sum("b").cast("double").alias("n2"),
        F.sum(F.col("x") * F.col("a")).alias("s1"), F.sum(F.col("x") * F.col("b")).alias("s2"),
    ).where("n1 > 0 and n2 > 0")
    whole = whole.withColumns({"m1": F.col("s1") / F.col("n1"), "m2": F.col("s2") / F.col("n2")}).drop("s1", "s2")
    placed = counted.join(whole, keys).withColumn("r", F.size(F.filter("q", lambda q: q < F.col("x")))).drop("q")
    range_ = placed.groupBy(*keys, "r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.min("x").alias("low"))
    order = W.partitionBy(*keys).orderBy("r")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = range_.select(*keys, "r", zero("ra").alias("oa"), zero("rb").alias("ob"), F.lead("low").over(order).alias("next"))
    inner = W.partitionBy(*keys, "r").orderBy("x")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    met = placed.join(offsets, [*keys, "r"])
    t = (F.col("a") + F.col("b")).cast("double")
    ranked = met.withColumns({"ca": F.col("oa") + F.sum("a").over(upto), "cb": F.col("ob") + F.sum("b").over(upto), "gap": F.coalesce(F.lead("x").over(inner), "next") - F.col("x")})
    mid = F.col("ca") + F.col("cb") - t + (t + 1) / 2
    area = F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2")) * F.col("gap")
    off = lambda m: (F.col("x") - F.col(m)) * (F.col("x") - F.col(m))
    sums = ranked.groupBy(*keys).agg(
        F.sum(mid * F.col("a")).alias("r1"), F.sum(t * t * t - t).alias("ties"), F.coalesce(F.sum(area), F.lit(0.0)).alias("distance"),
        F.sum(off("m1") * F.col("a")).alias("q1"), F.sum(off("m2") * F.col("b")).alias("q2"), *[F.first(c).alias(c) for c in ("n1", "n2", "m1", "m2")],
    )
    n1, n2 = F.col("n1"), F.col("n2")
    v1, v2 = F.try_divide("q1", n1 - 1), F.try_divide("q2", n2 - 1)
    return sums.select(
        *keys, n1, n2, stats.mann_whitney(n1, n2, F.col("r1"), F.col("ties")).alias("mwu"), stats.welch(n1, F.col("m1"), v1, n2, F.col("m2"), v2).alias("welch"), "distance"
    )


def rank_tests(base: DataFrame, today: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, mwu struct, distance) of one metric."""
    return compare(pooled(base, today, group, {value: F.col(value)}), group).select(*group, "mwu", "distance")


def permutation_p(pool: DataFrame, seen: DataFrame, keys: list[str], permutations: int, parts: int = 16) -> DataFrame:
    """(keys, p): how many of ``permutations`` random relabellings have at least the distance of ``seen``
    (keys, distance, n1).

    A relabelling deals the baseline's label to the n1 rows of least digest of its number and the row's
    id, so a rerun gives the same p. Rows are ranked inside ``parts`` ranges of the digest, so a large
    key's relabelling is not one task.
    """
    goal = seen.select(*keys, F.col("distance").alias("seen"), F.col("n1").alias("size"))
    rows = pool.join(goal.select(*keys, "size"), keys).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    rows = rows.withColumn("d", F.md5(F.concat_ws("-", F.col("j"), F.col("id")).cast("binary")))
    rows = rows.withColumn("r", F.floor(F.conv(F.substring("d", 1, 2), 16, 10).cast("int") * parts / 256))
    each = [*keys, "j"]
    before = W.partitionBy(*each).orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*each, "r").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(*each, "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    place = F.col("o") + F.row_number().over(W.partitionBy(*each, "r").orderBy("d", "id"))
    dealt = rows.join(offsets, [*each, "r"]).withColumn("a", (place <= F.col("size")).cast("int"))
    made = compare(dealt.select(*each, "x", "a", (1 - F.col("a")).alias("b")), each).join(goal, keys)
    # equal distances are summed in another order
    return made.groupBy(*keys).agg((F.count_if(F.col("distance") >= F.col("seen") * (1 - 1e-9) - 1e-12) / permutations).alias("p"))


def detect(rows: DataFrame, cfg: Detection) -> DataFrame:
    """One row a group with rows on both sides: sizes, medians, the tests of rtt, rates and loss, the
    changes and the flags.

    Tests are null, and flags 0, where a side has ``least_samples`` values or fewer. rtt: either test
    and a median risen by ``rtt_rise``. Rates: both tests, the permutation test of the distance, and a
    median fallen by the share ``drop``; the permutations are only made where all else holds, elsewhere their
    p is null. Loss: more lossy tests by ``z`` and by a tenth, and not contradicted by the severity among lossy tests:
    that is untestable, significant, or the tail is heavy.
    """
    base, today = split_window(rows, cfg)
    group, rates = list(cfg.group), rates_of(rows, cfg)
    pool = pooled(base, today, group, {"rtt": F.col("rtt"), **{r: F.col(r) for r in rates}, "severity": F.when(F.col("loss") > cfg.lossy, F.col("loss"))})
    tests = compare(pool, [*group, "metric"])
    least = F.when(F.col("metric") == "severity", F.lit(cfg.lossy_samples)).otherwise(F.lit(cfg.least_samples + 1))
    tests = tests.where((F.col("n1") >= least) & (F.col("n2") >= least))
    tests = tests.withColumn("welch_p", stats.welch_p(F.col("welch.t_stat"), F.col("welch.degrees_of_freedom")))
    one = lambda m: F.first(F.when(F.col("metric") == m, F.struct("mwu", "welch", "welch_p", "distance", "n1")), True).alias(f"t_{m}")
    wide = tests.groupBy(*group).agg(*[one(m) for m in ("rtt", *rates, "severity")])
    met = summary(base, cfg, "base").join(summary(today, cfg, "day"), group).join(wide, group, "left")
    met = met.withColumn("z_loss", stats.loss_z(F.col("base_lossy"), F.col("base_losses"), F.col("day_lossy"), F.col("day_losses")))
    met = met.withColumns({f"change_{r}": F.try_divide(F.col(f"day_median_{r}") - F.col(f"base_median_{r}"), F.nullif(F.col(f"base_median_{r}"), F.lit(0.0))) for r in rates})
    fell = {r: F.coalesce((F.col(f"t_{r}.welch_p") < cfg.p) & (F.col(f"t_{r}.mwu.p_value") < cfg.p) & (F.col(f"change_{r}") <= cfg.drop), F.lit(False)) for r in rates}
    if rates:
        met = settle(met)  # one row a group
        fallen = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("metric"), F.col(f"t_{r}.distance").alias("distance"), F.col(f"t_{r}.n1").alias("n1"))) for r, c in fell.items()])))
        seen = met.select(*group, fallen.alias("f")).select(*group, "f.*")
        p = permutation_p(pool, seen, [*group, "metric"], cfg.permutations)
        p = p.groupBy(*group).agg(*[F.max(F.when(F.col("metric") == r, F.col("p"))).alias(f"p_{r}") for r in rates])
        met = met.join(p, group, "left")
    tested = F.col("t_rtt").isNotNull()
    rtt = ((F.col("t_rtt.welch_p") < cfg.p) | (F.col("t_rtt.mwu.p_value") < cfg.p)) & (F.col("day_median") >= F.col("base_median") + cfg.rtt_rise)
    loss = over(F.col("z_loss"), cfg.z) & (F.col("day_lossy_share") >= 0.10) & (F.col("day_lossy_share") >= F.col("base_lossy_share") + 0.10)
    tail = F.col("day_p95_loss") >= strict_greatest(F.lit(0.03), F.col("base_p95_loss") + 0.02)
    severe = F.col("t_severity").isNull() | F.coalesce(F.col("t_severity.mwu.p_value") < cfg.p, F.lit(False)) | F.coalesce(tail, F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return met.select(
        *group, "base_n", "base_ips", "day_n", "base_median", "day_median", F.col("t_rtt.mwu").alias("mwu"), F.col("t_rtt.welch").alias("welch"), F.col("t_rtt.welch_p").alias("welch_p"),
        F.col("t_rtt.distance").alias("distance"), F.when(tested, F.col("z_loss")).alias("z_loss"), F.col("t_severity.mwu").alias("severity"),
        "base_lossy_share", "day_lossy_share", "base_p95_loss", "day_p95_loss",
        *[c for r in rates for c in (F.col(f"base_median_{r}"), F.col(f"day_median_{r}"), F.col(f"change_{r}"), F.col(f"t_{r}.mwu").alias(f"mwu_{r}"), F.col(f"t_{r}.welch_p").alias(f"welch_p_{r}"), F.col(f"t_{r}.distance").alias(f"distance_{r}"), F.col(f"p_{r}"))],
        flag(rtt).alias("anomaly_rtt"), *[flag(fell[r] & (F.col(f"p_{r}") < cfg.p)).alias(f"anomaly_{r}") for r in rates], flag(tested & loss & severe).alias("anomaly_loss"),
    )


def anomaly_ratios(rows: DataFrame, cfg: Detection) -> DataFrame:
    """Share of today's rows beyond the baseline median: of rtt by ``rtt_rise``, of the rates below it;
    null, not 0, if none is."""
    base, today = split_window(rows, cfg)
    group, rates = list(cfg.group), rates_of(rows, cfg)
    met = today.join(summary(base, cfg, "base").select(*group, "base_median", *[f"base_median_{r}" for r in rates]), group)
    share = lambda hit, c: F.try_divide(F.nullif(F.count_if(hit), F.lit(0)), F.count(c))
    return met.groupBy(*group).agg(
        share(F.col("rtt") > F.col("base_median") + cfg.rtt_rise, "rtt").alias("ratio"), F.count(F.lit(1)).alias("n"), *[share(F.col(r) < F.col(f"base_median_{r}"), r).alias(f"ratio_{r}") for r in rates]
    )


def roll_up(detected: DataFrame, keys: list[str]) -> DataFrame:
    """Groups gathered to fewer keys: counts, sums of the flags, mean and greatest rise of rtt, mean and
    least change of every rate."""
    rise = F.col("day_median") - F.col("base_median")
    flags = [c for c in detected.columns if c.startswith("anomaly_")]
    changes = [c for c in detected.columns if c.startswith("change_")]
    return detected.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("anomaly_rtt").alias("anomalous"), *[F.sum(c).alias(c) for c in flags if c != "anomaly_rtt"],
        F.avg(rise).alias("mean_rise"), F.max(rise).alias("most_rise"), *[x for c in changes for x in (F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"least_{c}"))],
    )
