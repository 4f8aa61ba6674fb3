"""Localising causes: edge prevalence, temporal verdicts, greedy set cover and its coarser forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import stats
from driftline.operators.lineage import settle


def pair_edges(edges: DataFrame, measurements: DataFrame) -> DataFrame:
    """(edge, pair, path_type) -> n measurements. A measurement belongs to one pair, so counts over any
    set of pairs are sums of these rows; the set cover works on them alone."""
    return edges.join(measurements, "id").groupBy("edge", "pair", "path_type").agg(F.countDistinct("id").alias("n"))


def edge_stats(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Per edge: anomalous and healthy measurements through it, support (anomalous pairs), Fisher p, odds."""
    kind = lambda k: F.col("path_type") == k
    per = counts.groupBy("edge").agg(
        F.coalesce(F.sum(F.when(kind("anomalous"), F.col("n"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(kind("healthy"), F.col("n"))), F.lit(0)).alias("h"),
        F.countDistinct(F.when(kind("anomalous"), F.col("pair"))).alias("support"),
    )
    met = per.crossJoin(F.broadcast(totals))  # one row
    f = stats.fisher_exact("a", "total_a", "h", "total_h")
    return met.withColumn("f", f).select("edge", "a", "h", "support", F.col("f.p").alias("p"), F.col("f.odds").alias("odds"))


def totals(measurements: DataFrame) -> DataFrame:
    return measurements.agg(F.count_if(F.col("path_type") == "anomalous").alias("total_a"), F.count_if(F.col("path_type") == "healthy").alias("total_h"))


def greedy_cover(edges: DataFrame, measurements: DataFrame, least_support: int = 2, most_p: float = 0.01, least_odds: float = 1.5, most_rounds: int = 200) -> tuple[list[dict], DataFrame]:
    """Culprit edges in rounds, and the pairs each explains.

    Every round scores the edges on the still unexplained pairs and takes the best int(100 / round) + 1
    at once (by pairs explained, p, name); rounds count from 2. It ends without candidates, at 95 % of
    the pairs, after five rounds without progress, when ten rounds gain under 1 %, or at the last round.
    Only the picks of a round (51 at most) come to the driver; counts stay distributed, and the lineage
    of what is left ends with every round.
    """
    counts = settle(pair_edges(edges.where(~F.col("edge").contains("*")), measurements))
    whole = settle(totals(measurements))
    left = settle(measurements.where("path_type = 'anomalous'").select("pair").distinct())
    goal = left.count()
    done, picks, history, idle = 0, [], [], 0
    explained = edges.sparkSession.createDataFrame([], "pair string, edge string")
    for step in range(2, most_rounds + 2):
        if not goal or done >= 0.95 * goal or idle >= 5:
            break
        if len(history) > 10 and history[-1] - history[-11] < 0.01 * goal:
            break
        open_ = counts.join(left, "pair", "left_semi").where("path_type = 'anomalous'").unionByName(counts.where("path_type = 'healthy'"))
        good = edge_stats(open_, whole).where((F.col("support") >= least_support) & (F.col("p") <= most_p) & (F.col("odds") >= least_odds))
        chosen = [r.asDict() | {"round": step} for r in good.orderBy(F.desc("support"), "p", "edge").limit(int(100 / step) + 1).collect()]
        if not chosen:
            break
        picks += chosen
        hit = counts.where((F.col("path_type") == "anomalous") & F.col("edge").isin([c["edge"] for c in chosen]))
        new = settle(hit.join(left, "pair", "left_semi").groupBy("pair").agg(F.min("edge").alias("edge")))
        gained = new.count()
        explained = explained.unionByName(new)
        left = settle(left.join(new, "pair", "left_anti"))
        done += gained
        idle = idle + 1 if not gained else 0
        history.append(done)
    return picks, explained


#: How coarse an entity is: of equal covers the finer one is taken, and coarse ones may be demoted.
GRANULARITIES = {"edge": 0, "node": 1, "as": 2, "metro": 2, "ixp": 2}


def mixed_cover(
    uses: DataFrame, children: DataFrame | None = None, most_p: float = 0.01, least_support: int = 2, least_odds: float = 1.5, least_purity: float = 0.1, least_children: int = 2,
    keep_purity: float = 0.5, stop_at: float = 0.98, most_steps: int = 500,
) -> tuple[list[dict], DataFrame]:
    """(culprits, statistics of every entity) of one cover over entities of all granularities.

    ``uses`` has (id, pair, gran, entity, anomalous): a path of a pair goes through an entity; ``children``
    has (gran, entity, node): the nodes of coarse entities. Candidates have enough anomalous paths,
    purity (their share of all paths), significance and odds over all paths. Every step takes the
    candidate that is in most unexplained pairs (ties: purer, finer, name) among those that still have
    support and purity on the unexplained paths. A coarse one stands if enough of its nodes are plausible
    there and its purity is not far below the best of theirs; else its node in most of its pairs is taken
    instead, or, without any, it is out. The pairs of what is taken are explained.

    Counts by (entity, pair) stay distributed; a step brings a few rows to the driver.
    """
    spark, key = uses.sparkSession, ["gran", "entity"]
    paths = lambda bad: F.countDistinct(F.when(F.col("anomalous") == bad, F.col("id")))
    counts = settle(uses.groupBy(*key, "pair").agg(paths(True).alias("a"), paths(False).alias("h")))
    pairs = settle(uses.groupBy("pair").agg(paths(True).alias("pa"), paths(False).alias("ph")))
    all_a, all_h, goal = pairs.agg(F.coalesce(F.sum("pa"), F.lit(0)), F.coalesce(F.sum("ph"), F.lit(0)), F.count_if(F.col("pa") > 0)).first()
    whole = counts.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("h").alias("h")).where(F.col("a") >= least_support)
    whole = settle(whole.withColumn("f", stats.fisher_exact("a", F.lit(all_a), "h", F.lit(all_h))).select(*key, "a", "h", F.col("f.p").alias("p"), F.col("f.odds").alias("odds")))
    purity = F.col("a") / (F.col("a") + F.col("h"))
    pool = whole.where((purity >= least_purity) & (F.col("p") <= most_p) & (F.col("odds") >= least_odds))
    open_ = settle(counts.join(pool.select(*key), key, "left_semi"))
    children = children if children is not None else spark.createDataFrame([], "gran string, entity string, node string")
    left_a, left_h, done, out = all_a, all_h, 0, []
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GRANULARITIES.items() for x in kv]), "gran"), F.lit(9))

    def plausible(rows: DataFrame) -> DataFrame:
        return rows.where((F.col("a") >= least_support) & (purity >= least_purity))

    for step in range(1, most_steps + 1):
        if not goal or goal - done <= (1 - stop_at) * goal:
            break
        now = open_.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("h").alias("h"), F.count_if(F.col("a") > 0).alias("cover"))
        best = plausible(now).where(F.col("cover") >= least_support).orderBy(F.desc("cover"), purity.desc(), rank, "entity").limit(1).collect()
        if not best:
            break
        best, demoted = best[0], None
        taken = (best["gran"], best["entity"])
        if GRANULARITIES.get(best["gran"]) == 2:
            mine = open_.where((F.col("gran") == taken[0]) & (F.col("entity") == taken[1]) & (F.col("a") > 0)).select("pair", F.lit(1).alias("mine"))
            nodes = children.where((F.col("gran") == taken[0]) & (F.col("entity") == taken[1])).select(F.lit("node").alias("gran"), F.col("node").alias("entity")).distinct()
            kids = open_.join(nodes, key, "left_semi").join(mine, "pair", "left")
            kids = kids.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("h").alias("h"), F.count_if((F.col("mine") == 1) & (F.col("a") > 0)).alias("cover"))
            kids = plausible(kids).where("cover > 0").withColumn("purity", purity)
            n, most, main = kids.agg(F.count(F.lit(1)), F.max("purity"), F.max_by("entity", F.struct("cover", "purity", "entity"))).first()
            if n < least_children or best["a"] / (best["a"] + best["h"]) < keep_purity * most:
                if not n:
                    open_ = open_.where(~((F.col("gran") == taken[0]) & (F.col("entity") == taken[1])))
                    continue
                taken, demoted = ("node", main), f"{taken[0]}:{taken[1]}"
        rows = open_.where((F.col("gran") == taken[0]) & (F.col("entity") == taken[1]))
        a, h = rows.agg(F.sum("a"), F.sum("h")).first()
        covered = settle(rows.where("a > 0").select("pair").join(pairs, "pair"))
        n, gone_a, gone_h = covered.agg(F.count(F.lit(1)), F.sum("pa"), F.sum("ph")).first()
        p, odds = stats.fisher(a, left_a, h, left_h)
        ratio = (a / left_a) / (h / left_h) if h and left_a and left_h else float("inf")
        done += n
        out.append({
            "gran": taken[0], "entity": taken[1], "pairs": n, "purity": a / (a + h), "step": step, "demoted_from": demoted, "support": a, "healthy": h, "p": p, "odds": odds, "ratio": ratio,
            "explained": done, "share": done / goal,
        })
        left_a, left_h = left_a - gone_a, left_h - gone_h
        open_ = settle(open_.join(covered.select("pair"), "pair", "left_anti"))
    won = spark.createDataFrame([(x["gran"], x["entity"]) for x in out], "gran string, entity string").distinct().withColumn("w", F.lit(True))
    ratio = F.when(F.col("h") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("a") / F.lit(max(all_a, 1)), F.col("h") / F.lit(max(all_h, 1))))
    told = whole.join(F.broadcast(won), key, "left")  # at most a row a step
    return out, told.select(*key, "a", "h", "p", "odds", ratio.alias("ratio"), F.coalesce("w", F.lit(False)).alias("culprit"))


def edge_prevalence(edges: DataFrame, measurements: DataFrame) -> DataFrame:
    """(pair, edge): share of healthy (prev_u) and of the day's (prev_d) measurements through the edge,
    with the sizes. ``dayof`` marks the day's measurements."""
    sizes = measurements.groupBy("pair").agg(F.countDistinct(F.when(~F.col("dayof"), F.col("id"))).alias("healthy_n"), F.countDistinct(F.when(F.col("dayof"), F.col("id"))).alias("dayof_n"))
    per = edges.join(measurements, "id").groupBy("pair", "edge").agg(F.countDistinct(F.when(~F.col("dayof"), F.col("id"))).alias("u"), F.countDistinct(F.when(F.col("dayof"), F.col("id"))).alias("d"))
    met = per.join(sizes, "pair")
    return met.select("pair", "edge", F.coalesce(F.try_divide("u", "healthy_n"), F.lit(0.0)).alias("prev_u"), F.coalesce(F.try_divide("d", "dayof_n"), F.lit(0.0)).alias("prev_d"), "healthy_n", "dayof_n")


def verdicts(prevalence: DataFrame, by: list[str], tau: float = 1.0, least: int = 5) -> DataFrame:
    """Per pair the divergence of both directions, the verdict and the edge that changed most;
    ``prevalence`` has direction (forward, reverse), base_rtt and day_rtt."""
    gain = F.greatest(F.lit(0.0), F.coalesce("prev_d", F.lit(0.0)) - F.coalesce("prev_u", F.lit(0.0)))
    slower = F.when((F.col("prev_u") > 0) & (F.col("prev_d") > 0), F.col("day_rtt") - F.col("base_rtt"))
    f = F.col("direction") == "forward"
    per = prevalence.withColumns({"g": gain, "s": slower}).groupBy(*by).agg(
        # rounded, so that the order of the sum cannot decide a comparison
        F.round(F.sum(F.when(f, F.col("g"))), 9).alias("div_f"), F.round(F.sum(F.when(~f, F.col("g"))), 9).alias("div_r"),
        F.max("healthy_n").alias("healthy_n"), F.max("dayof_n").alias("dayof_n"),
        F.max_by("edge", F.when(F.col("g") > 0, F.struct("g", "edge"))).alias("changed"),
        F.max_by("edge", F.when(F.col("s").isNotNull(), F.struct("s", "edge"))).alias("slowest"),
    )
    what, way = stats.verdict(F.col("div_f"), F.col("div_r"), F.col("healthy_n"), F.col("dayof_n"), tau, least)
    told = per.withColumns({"verdict": what, "direction": way})
    return told.select(
        *by, "verdict", "direction", F.coalesce("div_f", F.lit(0.0)).alias("div_f"), F.coalesce("div_r", F.lit(0.0)).alias("div_r"),
        F.when(F.col("verdict") == "reroute", F.col("changed")).alias("changed_segment"), F.when(F.col("verdict") == "congestion_in_place", F.col("slowest")).alias("congested_segment"),
    )


def agrees(verdict_rows: DataFrame, culprits: DataFrame, by: list[str]) -> DataFrame:
    """Whether a verdict's segment is one of the pair's culprit edges, in either orientation."""
    flip = F.concat_ws("-", F.reverse(F.split("edge", "-")))
    both = culprits.select(*by, F.col("edge").alias("c")).unionByName(culprits.select(*by, flip.alias("c"))).groupBy(*by).agg(F.collect_set("c").alias("cs"))
    segment = F.coalesce("changed_segment", "congested_segment")
    return verdict_rows.join(both, by, "left").withColumn("agrees_with_culprit", F.coalesce(F.array_contains("cs", segment), F.lit(False))).drop("cs")


def path_local(hops: DataFrame, explained: DataFrame, flagged: Column, reason: Column) -> DataFrame:
    """For unexplained pairs the first flagged hop of the merged path and the last good node before it;
    hops are ordered by TTL, then node."""
    left = hops.join(explained.select("pair").distinct(), "pair", "left_anti").withColumn("bad", F.coalesce(flagged, F.lit(False))).withColumn("reason", reason)
    place = F.struct("ttl", "node")
    first = left.where("bad").groupBy("pair").agg(F.min(place).alias("first"), F.min_by("reason", place).alias("reason"))
    before = left.where("not bad").join(first.select("pair", "first"), "pair").where(place < F.col("first"))
    good = before.groupBy("pair").agg(F.max_by("node", place).alias("good"))
    return first.join(good, "pair", "left").select("pair", "good", F.col("first.node").alias("node"), "reason")


def path_local_either(forward: DataFrame, reverse: DataFrame, explained: DataFrame, flagged: Column, flagged_reverse: Column, reason: Column) -> DataFrame:
    """The forward path's flagged hop, else the reverse path's; ``direction`` says which."""
    f = path_local(forward, explained, flagged, reason).withColumn("direction", F.lit("forward"))
    r = path_local(reverse, explained, flagged_reverse, reason).withColumn("direction", F.lit("reverse"))
    return f.unionByName(r.join(f.select("pair"), "pair", "left_anti"))


def hyperedges(edges: DataFrame, culprits: DataFrame) -> DataFrame:
    """Share of each node's edges that are culprits, at every granularity of ``edges``
    (gran, node, edge)."""
    every = edges.groupBy("gran", "node").agg(F.countDistinct("edge").alias("total"))
    hit = edges.join(culprits.select("edge").distinct(), "edge", "left_semi").groupBy("gran", "node").agg(F.countDistinct("edge").alias("culprit"))
    return every.join(hit, ["gran", "node"], "left").select("gran", "node", "total", F.coalesce("culprit", F.lit(0)).alias("culprit"), F.coalesce(F.try_divide("culprit", "total"), F.lit(0.0)).alias("share"))


def cumulative(picks: DataFrame) -> DataFrame:
    """Picks of several covers in order, with the running sum of the pairs they explain; picks are few."""
    w = W.orderBy("step", "entity").rowsBetween(W.unboundedPreceding, 0)
    return picks.withColumn("explained", F.sum("pairs").over(w))


def temporal_fractions(edges: DataFrame, measurements: DataFrame) -> DataFrame:
    """Per edge the share of anomalous and of other measurements through it, and their ratio."""
    whole = measurements.agg(F.count_if("bad").alias("ta"), F.count_if(~F.col("bad")).alias("th"))
    per = edges.join(measurements, "id").groupBy("edge").agg(F.countDistinct(F.when(F.col("bad"), F.col("id"))).alias("a"), F.countDistinct(F.when(~F.col("bad"), F.col("id"))).alias("h"))
    met = per.crossJoin(F.broadcast(whole))
    a, h = F.try_divide("a", "ta"), F.try_divide("h", "th")
    return met.select("edge", "a", "h", a.alias("share_a"), h.alias("share_h"), F.try_divide(a, h).alias("ratio"))
