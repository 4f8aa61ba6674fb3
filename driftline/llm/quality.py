"""Importance resampling: hashed n-gram generative models of target and raw text, Gumbel top-k.

A text's log importance weight is the sum over its features of the log ratio of the two models. The
draw uses it as it is; where texts of all lengths are judged alike, the mean a feature is used.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, held, small_batches

TOKENS = re.compile(r"\w+|[^\w\s]+")
#: Features of ratio 0 that are added to every text before its mean is taken, so that a few words alone
#: decide little.
PRIOR = 30


class Features:
    """Hashed word unigrams and bigrams of a whole text, as bucket numbers."""

    def __init__(self, buckets: int, remember: int = 100_000):
        self.buckets, self.remember, self.seen = np.uint64(buckets), remember, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKENS.findall(text.lower()) if text else []
        if not tokens:
            return np.empty(0, dtype=np.int64)
        if len(self.seen) > self.remember:
            self.seen.clear()
        seen = self.seen
        for t in tokens:
            if t not in seen:
                seen[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(seen.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        with np.errstate(over="ignore"):
            pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
            both = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), pairs])
            both ^= both >> np.uint64(32)
            both *= np.uint64(0xD6E8FEB86659FD93)
            both ^= both >> np.uint64(29)
        return (both % self.buckets).astype(np.int64)


@dataclass(frozen=True)
class ImportanceModel:
    """Log ratio of target to raw probability for each bucket; ``cut`` parts accepted from rejected."""

    log_ratio: np.ndarray
    cut: float

    @property
    def empty(self) -> bool:
        return not self.log_ratio.any()


def _labelled(labels: DataFrame, max_labels: int) -> DataFrame:
    """At most ``max_labels`` ids a class, of least id hash; so its size is bounded for a broadcast."""
    clean = labels.select(F.col("doc_id").alias("__lid"), F.col("quality").cast("int").alias("__q")).where("__lid is not null and __q in (0, 1)")
    one = clean.groupBy("__lid").agg(F.min("__q").alias("__q"))
    parts = [one.where(F.col("__q") == q).orderBy(F.xxhash64("__lid"), "__lid").limit(max_labels) for q in (0, 1)]
    return parts[0].unionByName(parts[1])


def _score_udf(log_ratio: np.ndarray, buckets: int):
    @F.pandas_udf("n long, sum double")
    def score(texts: pd.Series) -> pd.DataFrame:
        make = held(("features", buckets), lambda: Features(buckets))
        n, sums = [], []
        for t in texts:
            b = make(t)
            n.append(len(b))
            sums.append(float(log_ratio[b].sum()))
        return pd.DataFrame({"n": n, "sum": sums})

    return score


def _mean(s: Column) -> Column:
    """Log ratio a feature, with ``PRIOR`` features of ratio 0 added."""
    return s["sum"] / (s["n"] + PRIOR)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", buckets: int = 1 << 17, max_labels: int = 20_000, keep_good: float = 0.9995) -> ImportanceModel:
    """The raw model counts every text; the target model counts texts labelled good (quality 1). At most
    ``max_labels`` labelled ids a class are used, the documented bound of the fitted sample; a fifth of
    them, by id hash, is held out of the target model.

    The cut is set on the held-out texts: midway between the classes' mean log ratios where these part,
    else at the mean that ``keep_good`` of the good ones exceed. Without good labels every ratio is 0
    and all is accepted. Of several labels of one id the least counts.
    """
    small_batches(docs.sparkSession)
    sample = cut(_labelled(labels, max_labels).withColumn("__held", F.pmod(F.xxhash64("__lid", F.lit(5)), F.lit(5)) == 0))
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    learn = sample.where("__q = 1 and not __held").select("__lid")
    known = named.join(F.broadcast(learn), named["__id"] == F.col("__lid"), "left").select("__t", F.col("__lid").isNotNull().alias("__good"))

    def count(batches):
        make, raw, good = held(("features", buckets), lambda: Features(buckets)), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for pdf in batches:
            for i in range(0, len(pdf), 64):  # a bounded number of texts at once
                found = [make(t) for t in pdf["__t"].iloc[i : i + 64]]
                raw += np.bincount(np.concatenate(found), minlength=buckets)
                if liked := [b for b, q in zip(found, pdf["__good"].iloc[i : i + 64]) if q]:
                    good += np.bincount(np.concatenate(liked), minlength=buckets)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"b": at, "raw": raw[at], "good": good[at]})

    # as many rows as buckets
    sums = known.mapInPandas(count, "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    if sums.empty or not sums["good"].sum():
        return ImportanceModel(np.zeros(buckets), float("-inf"))
    sums = sums.set_index("b").reindex(range(buckets), fill_value=0)
    raw, good = sums["raw"].to_numpy() + 1.0, sums["good"].to_numpy() + 1.0
    log_ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    # nondeterministic, so that Spark does not move it below the join and score every text
    score = _score_udf(log_ratio, buckets).asNondeterministic()
    held_out = named.join(F.broadcast(sample.where("__held")), named["__id"] == F.col("__lid")).select("__q", score("__t").alias("s"))
    q = held_out.where("s.n > 0").groupBy("__q").agg(F.percentile_approx(_mean(F.col("s")), F.array(F.lit(1 - keep_good), F.lit(keep_good)), 10_000).alias("p"))
    spans = {r["__q"]: r["p"] for r in q.collect()}
    if 1 not in spans:  # too few labels to hold any out
        return ImportanceModel(log_ratio, float("-inf"))
    at = spans[1][0]
    if 0 in spans and spans[0][1] < at:
        at = (spans[0][1] + at) / 2
    return ImportanceModel(log_ratio, float(at))


def weigh(docs: DataFrame, model: ImportanceModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__log_weight`` (the sum of its features' log ratios), ``__mean_log_ratio`` (a
    feature), ``__features`` and ``__accepted`` (the mean reaches the model's cut). Null, empty and blank
    texts have no feature, weight 0 and are not accepted. Whole texts are read. Other columns pass;
    repeated rows get equal answers."""
    small_batches(docs.sparkSession)
    score = _score_udf(model.log_ratio, len(model.log_ratio))
    told = docs.withColumn("__s", score(F.col(text_col)))
    mean = _mean(F.col("__s"))
    ok = (F.col("__s.n") > 0) & (mean >= F.lit(model.cut))
    return told.withColumns({"__features": F.col("__s.n"), "__log_weight": F.col("__s.sum"), "__mean_log_ratio": mean, "__accepted": ok}).drop("__s")


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest value of a long column, by histograms of at most ``bins`` + 1 rows each."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = -(-(high - low + 1) // bins)
        part = df.where(F.col(col).between(low, high))
        counts = part.groupBy(((F.col(col) - low) / width).cast("long").alias("i") if width == 1 else F.expr(f"({col} - ({low}L)) div {width}L").alias("i")).count().collect()
        for r in sorted(counts, key=lambda r: -r["i"]):
            if r["count"] >= k:
                low, high = low + r["i"] * width, min(high, low + (r["i"] + 1) * width - 1)
                break
            k -= r["count"]
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Gumbel top-k: the ``share`` of rows with the largest log importance weight plus Gumbel noise, which
    is a draw without replacement in proportion to the weights.

    Returns doc_id, n_features, log_weight, mean_log_ratio, accepted, gumbel_key, selected. Noise comes
    from a hash of id and text, so a rerun draws the same sample; rows equal at the k-th key (repeated
    rows, in effect) are all selected. An empty table gives no rows.
    """
    model = fit(docs, labels, text_col=text_col, id_col=id_col, **params)
    scored = weigh(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t")), model, "__t")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "__t", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    keyed = scored.select(
        "doc_id", F.col("__features").alias("n_features"), F.col("__log_weight").alias("log_weight"), F.col("__mean_log_ratio").alias("mean_log_ratio"),
        F.col("__accepted").alias("accepted"), F.round((F.col("__log_weight") - F.log(-F.log(u))) * 1e9).cast("long").alias("k"),
    )
    keyed = cut(keyed)
    n = keyed.count()
    at = kth_largest(keyed, "k", round(n * share))
    chosen = F.col("k") >= F.lit(at).cast("long") if at is not None else F.lit(False)
    return keyed.select("doc_id", "n_features", "log_weight", "mean_log_ratio", "accepted", (F.col("k") / 1e9).alias("gumbel_key"), chosen.alias("selected"))
