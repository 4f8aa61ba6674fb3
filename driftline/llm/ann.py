"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts with few edges between
them; a small classifier learns, from the direction of a vector, which parts its neighbours lie in.
Every row is indexed under its most probable part; a query is compared with the rows of its several
most probable parts. How many is set on the sample, for a recall above the one asked for.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import cut, held


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest inner products with each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 500):
        s = x[a : a + 500] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect_balanced(x: np.ndarray, parts: int, rng) -> np.ndarray:
    """Equal halves along the main direction, again and again, until there are ``parts`` (a power of 2)."""
    label = np.zeros(len(x), dtype=np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            c = x[g] - x[g].mean(axis=0) if len(g) else x[g]
            v = rng.standard_normal(x.shape[1])
            for _ in range(8):
                v = c.T @ (c @ v)
                v /= np.linalg.norm(v) or 1.0
            order = np.argsort(c @ v, kind="stable")
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = halves
    for i, g in enumerate(groups):
        label[g] = i
    return label


def refine(near: np.ndarray, label: np.ndarray, parts: int, slack: float = 1.05, sweeps: int = 6) -> np.ndarray:
    """Move vertices to the part that most of their neighbours are in, none above its allowed size."""
    n, k = near.shape
    u = np.concatenate([np.repeat(np.arange(n), k), near.ravel()])
    v = np.concatenate([near.ravel(), np.repeat(np.arange(n), k)])
    label, most = label.copy(), int(np.ceil(slack * n / parts))
    for _ in range(sweeps):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (u, label[v]), 1)
        own, best = votes[np.arange(n), label], votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - own
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return label


class Router:
    """One hidden layer from a unit vector to log odds of the parts."""

    def __init__(self, dim: int, parts: int, hidden: int, rng):
        self.w1 = rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim)
        self.b1 = np.zeros(hidden)
        self.w2 = rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden)
        self.b2 = np.zeros(parts)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1])
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def train(self, x: np.ndarray, target: np.ndarray, rng, epochs: int = 12, batch: int = 256, rate: float = 2e-3) -> None:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1])
        names = ("w1", "b1", "w2", "b2")
        m, v, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                i = order[a : a + batch]
                h = np.maximum(unit[i] @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                p = np.exp(z - z.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
                e = (d @ self.w2.T) * (h > 0)
                t += 1
                for n, g in (("w2", h.T @ d), ("b2", d.sum(0)), ("w1", unit[i].T @ e), ("b1", e.sum(0))):
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.999 * v[n] + 0.001 * g * g
                    step = rate * (1 - epoch / epochs) * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, n, getattr(self, n) - step)


def fit_router(x: np.ndarray, parts: int, recall: float, k: int, seed: int = 3) -> tuple[Router, int]:
    """The router of a sample, and how many parts to look in so that ``recall`` of the sample's own
    ``k`` nearest neighbours are found there."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, dtype=np.float64)
    router = Router(x.shape[1], parts, 128, rng)
    if parts == 1 or len(x) < 4:
        return router, parts
    near = neighbours(x, k)
    label = refine(near[:, :10], bisect_balanced(x / np.linalg.norm(x, axis=1, keepdims=True), parts, rng), parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    router.train(x, target, rng)
    odds = router(x)
    part = odds.argmax(axis=1)
    place = np.empty_like(part, shape=odds.shape)
    np.put_along_axis(place, np.argsort(-odds, axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    depth = np.take_along_axis(place, part[near], axis=1).ravel()
    found = np.cumsum(np.bincount(depth, minlength=parts)) / len(depth)
    return router, int(np.searchsorted(found, recall) + 1)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): non-null finite vectors with a component other than 0, of the table's usual length
    (the most frequent; ties: the greater). Nulls ids take no part."""
    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null")
    inf = float("inf")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)) & F.exists("v", lambda c: c != 0)
    plain = plain.where(good)
    usual = plain.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return plain.where(F.size("v") == (usual[0]["d"] if usual else 0))


def _routed(rows: DataFrame, router: Router, top: int | None) -> DataFrame:
    """(vec_id, v binary, part) for the best part, or ``top`` rows (.., part, place) for the best parts."""
    shared, key = rows.sparkSession.sparkContext.broadcast(router), uuid4().hex

    def route(batches):
        router = held(("router", key), lambda: shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            odds = router(x)
            best = np.argsort(-odds, axis=1, kind="stable")[:, : top or 1]
            at = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            place = np.tile(np.arange(best.shape[1]), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), raw.take(at), pa.array(best.ravel(), pa.int32()), pa.array(place, pa.int32())], names=["vec_id", "v", "part", "place"]
            )

    return rows.mapInArrow(route, "vec_id long, v binary, part int, place int")


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, ties included at the k-th; scores are summed anew in
    one fixed order, so equal vectors have equal scores."""
    out = []
    order = np.lexsort((ids,))
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
    repeated = len(starts) < len(ids)
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ x.T
        for j, s in enumerate(rough):
            qid, v = query_ids[a + j], q[a + j]
            s = np.where(ids == qid, -np.inf, s)
            every = np.maximum.reduceat(s, starts) if repeated else s
            least = np.partition(every, len(every) - k)[len(every) - k] if len(every) > k else -np.inf
            spare = 1e-9 * (1 + np.linalg.norm(v)) if np.isfinite(least) else 0.0
            c = np.flatnonzero((s >= least - spare) & (s > -np.inf))
            exact = (x[c] * v).sum(axis=1)
            best = np.lexsort((ids[c], -exact))
            seen, n = set(), 0
            for i in best:
                if ids[c[i]] not in seen:
                    seen.add(ids[c[i]])
                    out.append((qid, ids[c[i]], exact[i]))
                    n += 1
                    if n == k:
                        break
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(
    rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.92, sample: int = 10_240, block: int = 20_000, query_block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products found.

    ``rows`` are all indexed; the model is fitted on at most ``sample`` of them, those of least id hash.
    Rows of one part are dealt to blocks of about ``block`` rows, so no part grows with the data, and a
    query looks into further parts until they hold enough rows. Vectors that are null, zero, of another
    length than usual or hold a null or non-finite component take no part. Rows of one vec_id are one
    candidate with its best score; of several queries of one id the least vector asks. Ties go to the
    smaller vec_id. Other columns are not read. No usable query or row (an empty table): no result.
    """
    usable_rows = usable(rows, id_col, vec_col)
    fitted = usable_rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if fitted.empty:
        return usable_rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    x = np.vstack(fitted["v"].to_numpy())
    total = usable_rows.count()
    parts = 1 << int(np.log2(max(1, len(x) // 40)))  # some 40 rows of the sample a part
    router, probes = fit_router(x, parts, recall, k)
    placed = cut(_routed(usable_rows, router, None))
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.create_map(*[F.lit(int(y)) for p, n in sizes.items() for y in (p, -(-n // block))])
    asked = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = _routed(asked, router, parts)
    # parts are entered by place; the rows met before tell whether enough were seen
    size_of = F.create_map(*[F.lit(int(y)) for p, n in sizes.items() for y in (p, n)])
    met = F.coalesce(F.sum(F.coalesce(F.try_element_at(size_of, "part"), F.lit(0))).over(W.partitionBy("vec_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = asked.withColumn("met", met).where((F.col("place") < probes) | (F.col("met") < 10 * k)).where(F.try_element_at(blocks, "part").isNotNull())
    spread = -(-max(1, total // 20) * probes // (parts * query_block))
    asked = asked.select(
        F.col("vec_id").alias("query_id"), "v", "part", F.explode(F.sequence(F.lit(0), F.try_element_at(blocks, "part") - 1)).alias("b"),
        F.pmod(F.xxhash64("vec_id"), F.lit(spread)).cast("int").alias("qb"),
    )
    dealt = placed.select("vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), F.try_element_at(blocks, "part")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("qb"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        a = np.frombuffer(b"".join(left["v"]), dtype=np.float64).reshape(len(left), -1)
        b = np.frombuffer(b"".join(right["v"]), dtype=np.float64).reshape(len(right), -1)
        return _best(left["vec_id"].to_numpy(), a, right["query_id"].to_numpy(), b, k)

    key = ["part", "b", "qb"]
    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
