"""Near-duplicate documents by DartMinHash.

Darts are thrown by hashes at the plane of every element: a dart has a weight coordinate, a rank and
one of ``size`` sketch coordinates. Of the darts inside a set's region (weight below the element's
weight, here how often a shingle occurs) the one of least rank is kept per coordinate, so two sets
agree in a coordinate with probability equal to their weighted Jaccard similarity. An element's darts
arrive in order of rank, so only as many are made as fall under the rank that fills every coordinate:
about ``size`` log ``size`` for a set, not ``size`` for an element.

Bands of the sketch give candidate buckets. Inside a bucket no pairs are listed: every member is
compared, exactly, with the bucket's hub, the member that has most company over all its buckets. What
is then still open are members of one bucket that are in different classes. For these the exact
prefix rule of set joins applies: two sets of the wanted similarity have in common one of their
rarest shingles, so only members that meet there are compared. A text that its hub is not near has so
many shingles of its own that the common ones of a large group are not among its rarest, and a group
of copies costs about a row a copy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import broadcast_if_small, by_bytes, cut, held, small_batches
from driftline.llm.components import components

#: Rows of ids (8 or 16 bytes each) up to which a join may broadcast them.
MOST_IDS = 500_000
#: Guards whole numbers against rounding in products with the similarity.
NEARLY = 1e-9
U = np.uint64
STEP, SPLIT, COLUMN, TALL = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * SPLIT
    x = (x ^ (x >> U(27))) * COLUMN
    return x ^ (x >> U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(elements: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``size`` dart names of a non-empty set of hashed elements; weights (positive) are 1 by default."""
    with np.errstate(over="ignore"):
        if weights is None or weights.max() == weights.min() == 1:
            cells, inside, total = _mix(elements), None, float(len(elements))
        else:  # a cell for each begun unit of weight; the last one is partly inside
            times = np.ceil(weights).astype(np.int64)
            unit = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            cells = _mix(np.repeat(elements, times) + unit.astype(U) * TALL)
            inside, total = np.minimum(np.repeat(weights, times) - unit, 1.0), float(weights.sum())
            inside = None if inside.min() == 1 else inside
        limit = size * (math.log(size) + 3) / total
        while True:
            chunk = max(2, math.ceil(limit) + 1)
            seed, base, share = cells, np.zeros(len(cells)), inside
            first, names, ranks = 0, [], []
            while len(seed):
                darts = seed[:, None] + np.arange(first + 1, first + chunk + 1, dtype=U) * STEP
                name = _mix(darts)
                rank = base[:, None] + np.cumsum(-np.log(_unit(name)), axis=1)
                hit = rank <= limit
                if share is not None:
                    hit &= _unit(_mix(name ^ TALL)) < share[:, None]
                names.append(name[hit])
                ranks.append(rank[hit])
                on = rank[:, -1] <= limit
                seed, base, first = seed[on], rank[on, -1], first + chunk
                share = share[on] if share is not None else None
            name, rank = np.concatenate(names), np.concatenate(ranks)
            late = np.argsort(-rank, kind="stable")
            name = name[late]
            column = (_mix(name ^ COLUMN) % U(size)).astype(np.int64)
            out, filled = np.zeros(size, dtype=U), np.zeros(size, dtype=bool)
            out[column] = name  # the last written, of least rank, stays
            filled[column] = True
            if filled.all():
                return out
            limit *= 2


class Shingler:
    """Hashes of the distinct runs of ``words`` words of a text, and how often each occurs; a shorter
    text has one run."""

    def __init__(self, words: int, remember: int = 100_000):
        self.words, self.remember, self.known = words, remember, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.lower().split() if text else []
        if not tokens:
            return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, tokens), dtype=U, count=len(tokens))
        k = min(self.words, len(h))
        with np.errstate(over="ignore"):
            x = np.zeros(len(h) - k + 1, dtype=U)
            for j in range(k):
                x = x * TALL + h[j : len(h) - k + 1 + j] + STEP
            return np.unique(_mix(x), return_counts=True)


def occurrences(x: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One element for each occurrence of a shingle, so that the plain Jaccard similarity of two such
    sets is the weighted one of their shingles."""
    if times.max(initial=0) <= 1:
        return x
    nth = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(U)
    every = np.repeat(x, times)
    with np.errstate(over="ignore"):
        return np.where(nth == 0, every, _mix(every + nth * SPLIT))


def signatures(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), n (shingles, each as often as it occurs), c1, c2 (name of the
    shingles), bands array<long>, shingles array<int> (one number for each occurrence)."""

    def sign(batches):
        shingle = held(("shingles", words), lambda: Shingler(words))
        seeds = _mix(np.arange(bands, dtype=U) * STEP + U(1))
        for batch in by_bytes(batches, 1):
            n, c1, c2, keys, sets = [], [], [], [], []
            for text in batch.column(1):
                x, times = shingle(text.as_py())
                if not len(x):
                    n.append(0), c1.append(0), c2.append(0), keys.append([]), sets.append(np.empty(0, np.int32))
                    continue
                both = xxhash.xxh3_128_intdigest(x.tobytes() + times.tobytes())
                for to, v in ((c1, both >> 64), (c2, both & (1 << 64) - 1)):
                    to.append(v - (1 << 64) if v >> 63 else v)
                with np.errstate(over="ignore"):
                    s = sketch(x, bands * rows, times).reshape(bands, rows)
                    b = seeds
                    for j in range(rows):
                        b = _mix(b * TALL + s[:, j])
                every = np.unique((occurrences(x, times) >> U(32)).astype(np.uint32)).view(np.int32)
                n.append(len(every)), keys.append(b.view(np.int64)), sets.append(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))],
                names=["doc_id", "h", "n", "c1", "c2", "bands", "shingles"],
            )

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(sign, f"doc_id {kind}, h long, n long, c1 long, c2 long, bands array<long>, shingles array<int>")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingles have a Jaccard similarity of ``least`` or more."""
    x = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("m"), (F.size("sa") + F.size("sb")).alias("t"))
    return met.where(F.col("m") >= least * (F.col("t") - F.col("m")) - NEARLY).select("a", "b")


def _rarest(pool: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(w, pos, rid, size, comp, minor): the rarest shingles of every row of the pool, with their place.

    Shingles are ordered by how many rows of the pool have them. A shingle that no other row has takes
    a place but is not listed. A row whose shared shingles are too few for any partner goes.
    """
    own = sets.join(pool, "rid").select("rid", "comp", "minor", F.size("shingles").alias("size"), "shingles")
    words = cut(own.select("rid", "comp", "minor", "size", F.explode("shingles").alias("w")))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    shared = words.join(often, "w").groupBy("rid", "comp", "minor", "size").agg(F.array_sort(F.collect_list(F.struct("d", "w"))).alias("ws"))
    few = F.col("size") - F.size("ws")
    reach = F.floor(F.col("size") * (1 - least) + NEARLY).cast("int") + 1  # prefix for the smallest partner there can be
    listed = shared.where(F.size("ws") >= least * F.col("size") - NEARLY).withColumn("first", few).withColumn("ws", F.slice("ws", 1, F.greatest(reach - few, F.lit(0))))
    return listed.select("rid", "comp", "minor", "size", "first", F.posexplode("ws").alias("i", "x")).select(F.col("x.w").alias("w"), (F.col("first") + F.col("i")).alias("pos"), "rid", "size", "comp", "minor")


def _open_pairs(pool: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes, one of them minor, that meet in a shingle of both prefixes.

    Of two sets of sizes x and y at least ``need`` shingles are common, so the rarest common one is
    among the first x - need + 1 of the one and the first y - need + 1 of the other.
    """
    listed = cut(_rarest(pool, sets, least))
    x = listed.where("minor").select("w", F.col("rid").alias("x"), F.col("pos").alias("xp"), F.col("size").alias("xs"), F.col("comp").alias("xc"))
    y = listed.select("w", F.col("rid").alias("y"), F.col("pos").alias("yp"), F.col("size").alias("ys"), F.col("comp").alias("yc"), F.col("minor").alias("ym"))
    need = F.ceil((F.col("xs") + F.col("ys")) * (least / (1 + least)) - NEARLY)
    fits = (F.col("xp") <= F.col("xs") - need) & (F.col("yp") <= F.col("ys") - need)
    once = ~F.col("ym") | (F.col("x") < F.col("y"))
    met = x.join(y, "w").where((F.col("xc") != F.col("yc")) & once & fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _roots(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(rid, root) of every member in a class of several texts that is not its root; ``members`` has
    (key, rid, n, m), m the bucket's size."""
    company = members.groupBy("rid").agg(F.sum("m").alias("company"))
    best = F.max_by(F.struct("rid", "n"), F.struct("company", -F.col("rid"))).alias("hub")
    # cut, so that Spark can split a large bucket in the join that follows
    hubs = cut(members.join(company, "rid").groupBy("key").agg(best).select("key", F.col("hub.rid").alias("hub"), F.col("hub.n").alias("hub_n")))
    met = cut(members.join(hubs, "key").where(F.col("rid") != F.col("hub")))
    near = F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")
    pairs = met.where(near).select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")).distinct()
    labels = components(_similar(pairs, sets, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = labels.select(F.col("v").alias("rid"), "root")
    # every bucket's hub has met all others; the others are open if they are in several classes
    told = met.where("m > 2").join(labels, "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("comp"))
    classes = told.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    state = classes.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "comp"))["comp"].alias("most")).where("k > 1")
    pool = told.join(broadcast_if_small(cut(state), MOST_IDS), "key").groupBy("rid", "comp").agg(F.max(F.col("comp") != F.col("most")).alias("minor"))
    pool = cut(pool)
    if not pool.limit(1).count():
        return labels
    more = _similar(_open_pairs(pool, sets, similarity), sets, similarity)
    root = pool.select("rid", "comp")
    more = more.join(root.select(F.col("rid").alias("a"), F.col("comp").alias("u")), "a").join(root.select(F.col("rid").alias("b"), F.col("comp").alias("v")), "b")
    again = components(more.select("u", "v")).select(F.col("v").alias("old"), F.col("root").alias("new"))
    moved = labels.join(again, F.col("root") == F.col("old"), "left").select("rid", F.coalesce("new", "root").alias("root"))
    return cut(moved.unionByName(again.select(F.col("old").alias("rid"), F.col("new").alias("root"))))  # no class name is among the rids of labels


def _classes(docs: DataFrame, words: int, similarity: float, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    made = signatures(docs, words, bands, rows, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    made = cut(made)
    light = made.select("rid", "doc_id", "h", "n", "c1", "c2")
    same = cut(light.where("n > 0").groupBy("c1", "c2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = broadcast_if_small(same.select(F.col("rep").alias("rid")), MOST_IDS)
    keys = made.where("n > 0").select("rid", "n", "bands").join(reps, "rid", "left_semi").select("rid", "n", F.explode("bands").alias("key"))
    often = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    members = cut(keys.join(broadcast_if_small(often, MOST_IDS), "key"))
    labels = None
    if members.limit(1).count():
        known = broadcast_if_small(cut(members.select("rid").distinct()), MOST_IDS)
        sets = cut(made.select("rid", "shingles").join(known, "rid", "left_semi"))
        labels = _roots(members, sets, similarity)
    copies = broadcast_if_small(same.where("copies > 1").drop("copies"), MOST_IDS)
    rep = light.join(copies, ["c1", "c2"], "left").select("rid", "doc_id", "h", "n", F.when(F.col("n") > 0, F.coalesce("rep", "rid")).otherwise(F.col("rid")).alias("rep"))
    if labels is not None:
        rep = rep.join(broadcast_if_small(labels.select(F.col("rid").alias("rep"), "root"), MOST_IDS), "rep", "left").withColumn("rep", F.coalesce("root", "rep"))
    rep = cut(rep.select("rid", "doc_id", "h", "n", "rep"))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", "rid")
    classes = rep.groupBy("rep").agg(F.min("doc_id").alias("class_id"), F.min("h").alias("class_hash"), F.count(F.lit(1)).alias("class_size"), F.min(order)["rid"].alias("kept"))
    # classes of one row need no join, and cut, so that Spark can split a large class over tasks
    large = cut(classes.where("class_size > 1"))
    met = rep.join(broadcast_if_small(large, MOST_IDS), "rep", "left")
    return met.select(
        "doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_hash", "h").alias("class_hash"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("rid") == F.col("kept"), F.lit(True)).alias("keeps"),
    )


def near_duplicate_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, class_hash, class_size, keeps): the class of every row.

    Two texts are linked if the weighted Jaccard similarity of their ``words``-word shingles (lower
    case, split at white space, each weighing as often as it occurs) is ``similarity`` or more; classes
    are the components of the links and named by their least doc_id (null if all are null) and least
    text hash. A pair at the limit is missed by all bands with probability (1 - similarity^rows)^bands:
    7e-4 as given; what the bands bring together is settled exactly, none is capped. Whole texts are
    read, a bounded number of bytes at once. Texts without a word (null, empty, blank) are classes of
    one row each. Repeated rows are one class. ``keeps`` marks one row of each class: of the least id
    (null last), then of the least text hash, then any. Other columns are not read; an empty table
    gives no rows.
    """
    return _classes(docs, words, similarity, bands, rows, id_col, text_col).drop("h")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the row that ``keeps`` marks. Null, empty and blank texts
    all stay. Other columns pass."""
    told = cut(_classes(docs, words, similarity, bands, rows, id_col, text_col).select("doc_id", "h", "keeps"))
    gone = told.groupBy("doc_id", "h").agg(F.max("keeps").alias("k"), F.count(F.lit(1)).alias("m"))
    repeated = gone.where("k and m > 1").limit(1).count() > 0
    gone = broadcast_if_small(cut(gone.where("not k").select(F.col("doc_id").alias("__i"), F.col("h").alias("__g"))), MOST_IDS)
    keyed = docs.withColumn("__h", F.xxhash64(text_col))
    left = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g")), "left_anti")
    if repeated:  # rows of equal id and text; the shuffle is spared where there are none
        left = left.dropDuplicates([id_col, "__h"])
    return left.drop("__h")
