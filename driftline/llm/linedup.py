"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling.

Lines that occur once cannot be part of a repeated run; the others form, inside each document, maximal
segments. Suffixes are the lines of these segments up to the segment's end. A suffix's rank is the
pair (id of its first line, offset among the suffixes with that line); each doubling round orders the
suffixes of equal rank by the rank of the suffix 2^k lines on, so ranks after round k order suffixes
by their first 2^k lines and are equal exactly if those lines are. Rounds end once no two suffixes have
so many lines in common.

Suffixes of equal rank at depth 2^k are an interval of the array whose longest common prefix is 2^k
lines or more. From the deepest depth down every suffix is led to the interval of the longest common
prefix in which it is not the first in document order: a run of lines that is a later copy, and
maximal. The member that comes first stays in the interval above, and a second row of it stands in the
interval for the others to be compared with. Runs of ``min_words`` words or more are deleted.

All copies of a whole text but the first are one such run each, and their lines need no suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import broadcast_if_small, cut, cut_bare

LINE = r"\n"
#: What names a segment: its document, and its first line number less the shared lines before it.
SEGMENT = ["doc_id", "h", "seg"]
#: Rows of names that a join may broadcast.
MOST_ROWS = 20_000


def _deeper(state: DataFrame, k: int) -> tuple[DataFrame, int]:
    """``state`` with o<k + 1>, and the size of the largest set of suffixes of equal rank there.

    Equal pairs are counted before they are shuffled, so a line that a third of all rows share costs one
    row a task; the different followers of one line are dealt to ranges of their ids."""
    o = f"o{k}"
    after = F.lead(F.struct("a", "b", o), 1 << k).over(W.partitionBy(*SEGMENT).orderBy("line"))
    end = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(-1).cast("long").alias(o))
    paired = state.withColumn("y", F.coalesce(after, end)).withColumns({"ya": F.col("y.a"), "yb": F.col("y.b"), "yo": F.col(f"y.{o}")}).drop("y")
    paired = cut_bare(paired)
    rank, key = ["a", "b", o], ["a", "b", o, "ya", "yb", "yo"]
    # the end sorts first (its offset is -1), then the following ranks; a range is the first bits of ya
    range_ = F.when(F.col("yo") < 0, F.lit(-100).cast("long")).otherwise(F.shiftright("ya", 59))
    counts = cut_bare(paired.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("r", range_))
    before = W.partitionBy(*rank).orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.groupBy(*rank, "r").agg(F.sum("n").alias("n")).select(*rank, "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("less"))
    inner = W.partitionBy(*rank, "r").orderBy("ya", "yb", "yo").rowsBetween(W.unboundedPreceding, -1)
    ranks = counts.withColumn("in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(ranges, [*rank, "r"])
    ranks = ranks.select(*key, (F.col(o) + F.col("less") + F.col("in")).alias(f"o{k + 1}"))
    most = counts.where("yo >= 0").agg(F.max("n")).first()[0] or 0
    # cut, so that Spark can split the rows of one rank in the join
    return paired.join(broadcast_if_small(cut_bare(ranks), MOST_ROWS), key).drop("ya", "yb", "yo"), most


def suffix_ranks(state: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int]:
    """``state`` (doc_id, h, seg, line, a, b) with o0 .. o<K>, and K: a suffix's place among those of its
    first line (a, b) by the first 2^k lines; equal for equal lines. K is the first depth at which no two
    suffixes have 2^K lines in common, or ``rounds``."""
    state, k = state.withColumn("o0", F.lit(0).cast("long")), 0
    while rounds is None or k < rounds:
        state, most = _deeper(state, k)
        k += 1
        if rounds is None and most < 2:
            break
    return state, k


def later_runs(state: DataFrame) -> DataFrame:
    """``state`` (doc_id, h, seg, line, a, b, ..) with ``n``, the length of the longest run of lines from here
    that has been before, in document order (0: none), and ``first``, where it was first."""
    ranked, depth = suffix_ranks(state)
    offsets = [f"o{k}" for k in range(depth + 1)]
    left = F.max("line").over(W.partitionBy(*SEGMENT)) - F.col("line") + 1
    table = cut_bare(ranked.select(*SEGMENT, "line", "a", "b", *offsets, left.alias("left")))
    place = F.struct("doc_id", "h", "line", "seg", "left")
    kind = table.select(place.alias("p")).schema["p"].dataType
    none = F.lit(0).cast("long")
    found = table.select(*SEGMENT, "line", "left", none.alias("n"), none.alias("ca"), none.alias("cb"), F.lit(None).cast(kind).alias("first"), F.lit(False).alias("stands"))
    for k in range(depth - 1, -1, -1):
        on = table.select(*SEGMENT, F.col("line").alias("at"), F.col("a").alias("ya"), F.col("b").alias("yb"), F.col(f"o{k}").alias("yo"))
        wide = found.withColumn("at", F.when(F.col("left") - F.col("n") >= (1 << k), F.col("line") + F.col("n"))).join(on, [*SEGMENT, "at"], "left")
        wide = wide.withColumns({"na": F.when(F.col("ya").isNotNull(), F.xxhash64("ca", "cb", "ya", "yb", "yo")), "nb": F.when(F.col("ya").isNotNull(), F.xxhash64(F.lit(7), "ca", "cb", "ya", "yb", "yo"))})
        wide = cut_bare(wide.drop("ya", "yb", "yo", "at"))
        # cut, so that Spark can split the rows of a very common run in the join
        here = cut_bare(wide.where("na is not null").groupBy("na", "nb").agg(F.min(place).alias("start"), F.first("n").alias("sn"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
        met = wide.join(broadcast_if_small(here.drop("sn"), MOST_ROWS), ["na", "nb"], "left")
        later = F.coalesce(~F.col("stands") & (F.col("start") < place), F.lit(False))
        found = met.select(
            *SEGMENT, "line", "left", F.when(later, F.col("n") + (1 << k)).otherwise(F.col("n")).alias("n"), F.when(later, F.col("na")).otherwise(F.col("ca")).alias("ca"),
            F.when(later, F.col("nb")).otherwise(F.col("cb")).alias("cb"), F.when(later, F.col("start")).otherwise(F.col("first")).alias("first"), "stands",
        )
        first = here.select(*[F.col(f"start.{c}").alias(c) for c in (*SEGMENT, "line", "left")], (F.col("sn") + (1 << k)).alias("n"), F.col("na").alias("ca"), F.col("nb").alias("cb"), F.lit(None).cast(kind).alias("first"), F.lit(True).alias("stands"))
        found = found.unionByName(first)
    own = found.where("not stands").select(*SEGMENT, "line", "n", F.struct("first.doc_id", "first.h", "first.line").alias("at"), F.col("first").isNotNull().alias("seen"))
    return state.join(own.select(*SEGMENT, "line", "n", F.when(F.col("seen"), F.col("at")).alias("first")), [*SEGMENT, "line"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, h, g): non-null texts with 128 bits of their hash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t is not null")
    return rows.select("doc_id", "t", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(7), "t").alias("g"))


def _shared_lines(texts: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, h, seg, line, w, a, b): the lines that occur more than once, in segments of ``min_words`` words
    or more; w is a line's words."""
    lines = texts.select("doc_id", "h", F.posexplode(F.split("t", LINE)).alias("line", "s"))
    s = F.trim(F.col("s"))
    # a line's id has 128 bits; the texts end here
    ids = cut(
        lines.select(
            "doc_id", "h", F.col("line").cast("long").alias("line"), F.regexp_count(s, F.lit(r"\S+")).cast("long").alias("w"),
            F.xxhash64(s).alias("a"), F.xxhash64(F.lit(7), s).alias("b"),
        )
    )
    # cut, so that the join deals its rows by itself and a very common line can be split over tasks
    often = cut(ids.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"))
    shared = ids.join(often, ["a", "b"]).dropDuplicates(["doc_id", "h", "line"])
    shared = shared.withColumn("seg", F.col("line") - F.row_number().over(W.partitionBy("doc_id", "h").orderBy("line")))
    words = F.sum("w").over(W.partitionBy(*SEGMENT))
    return cut(shared.withColumn("words", words).where(F.col("words") >= min_words).select(*SEGMENT, "line", "w", "a", "b"))


def _measured(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The shared lines with n, first, the run's words and ``end``, the line after the furthest run of enough
    words that has begun; and the later copies of whole texts (doc_id, h, lines)."""
    texts = _texts(docs, id_col, text_col)
    whole = cut(texts.groupBy("h", "g").agg(F.min(F.struct("doc_id")).alias("f"), F.min(F.struct("doc_id")) != F.max(F.struct("doc_id"))).toDF("h", "g", "f", "many").where("many").drop("many"))
    told = texts.join(broadcast_if_small(whole, MOST_ROWS), ["h", "g"], "left").withColumn("again", F.coalesce(F.struct("doc_id") != F.col("f"), F.lit(False)))
    state = later_runs(_shared_lines(told.where("not again"), min_words))
    upto = W.partitionBy(*SEGMENT).orderBy("line")
    sums = state.withColumn("sum", F.sum("w").over(upto.rowsBetween(W.unboundedPreceding, 0)))
    ends = sums.select(*SEGMENT, (F.col("line") + 1).alias("stop"), F.col("sum").alias("to"))
    met = sums.withColumn("stop", F.col("line") + F.col("n")).join(ends, [*SEGMENT, "stop"], "left")
    met = met.withColumn("words", F.when(F.col("n") > 0, F.col("to") - F.col("sum") + F.col("w")).otherwise(0)).drop("to", "sum", "stop")
    reach = F.when(F.col("words") >= min_words, F.col("line") + F.col("n"))
    met = met.withColumn("end", F.max(reach).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    n = F.size(F.split("t", LINE)) - 1
    copies = told.where("again").where(F.regexp_count("t", F.lit(r"\S+")) >= min_words)
    return met, copies.select("doc_id", "h", F.sequence(F.lit(0).cast("long"), n.cast("long")).alias("lines"))


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, line, n, words, first): the maximal later copies of line runs that start inside texts, whole
    copies of texts apart: where, how many lines and words, and the place of the first copy."""
    met, _ = _measured(docs, min_words, id_col, text_col)
    inside = F.lag("n").over(W.partitionBy(*SEGMENT).orderBy("line")) > F.col("n")
    return met.withColumn("in", F.coalesce(inside, F.lit(False))).where((F.col("words") >= min_words) & ~F.col("in")).select("doc_id", "h", "line", "n", "words", "first")


def later_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, lines): the sorted line numbers from 0 that lie in a later copy of a repeated run.

    ``h`` is the hash of the text; rows of equal id and text are one document here. Documents are
    ordered by id (null first) and text hash. Lines are equal if their trimmed texts are; blank lines
    carry no words, so they go only inside a run. A run of ``min_words`` words or more that repeats
    inside one document counts too, also where the copies overlap: of a passage that is repeated on and on
    its first occurrence stays. Long texts are read whole.
    """
    met, copies = _measured(docs, min_words, id_col, text_col)
    gone = met.where(F.col("end") > F.col("line")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return gone.unionByName(copies.dropDuplicates(["doc_id", "h"]))


def delete_later_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of later copies deleted from the text, ``__n_lines`` (before) and
    ``__deleted`` (their numbers). Null texts stay null with no line, empty texts have one empty line;
    of equal texts the one of the least id (null first) keeps its lines, repeated rows of it all do;
    other columns pass; an empty table gives no rows."""
    gone = cut(later_copies(docs, min_words, id_col, text_col)).select(F.col("doc_id").alias("__i"), F.col("h").alias("__h"), F.col("lines").alias("__deleted"))
    if (gone.agg(F.sum(F.size("__deleted"))).first()[0] or 0) <= 500_000:  # line numbers; else by a shuffle
        gone = F.broadcast(gone)
    keyed = docs.withColumn("__x", F.xxhash64(text_col))
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__x") == F.col("__h")), "left")
    lines = F.split(F.col(text_col), LINE)
    left = F.array_join(F.filter(lines, lambda s, i: ~F.array_contains(F.col("__deleted"), i.cast("long"))), "\n")
    return joined.select(
        *[F.when(F.col("__deleted").isNull(), F.col(c)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("__n_lines"),
        F.coalesce("__deleted", F.array().cast("array<bigint>")).alias("__deleted"),
    )


def oracle(min_words: int = 50) -> str:
    """The same deletions in DuckDB SQL, stretches named by their text."""
    return rf"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS line FROM docs),
sums AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM (SELECT doc_id, line, trim(s) AS s, len(regexp_extract_all(s, '\S+')) AS w FROM lines)),
pairs AS (SELECT x.doc_id, x.line AS i, min(y.line) AS j FROM sums x JOIN sums y ON x.doc_id = y.doc_id AND y.line >= x.line AND y.upto - x.upto + x.w >= {min_words} GROUP BY ALL
 UNION SELECT y.doc_id, max(x.line), y.line FROM sums x JOIN sums y ON x.doc_id = y.doc_id AND y.line >= x.line AND y.upto - x.upto + x.w >= {min_words} GROUP BY y.doc_id, y.line),
named AS (SELECT p.doc_id, p.i, p.j, string_agg(s.s, chr(10) ORDER BY s.line) AS name, count(*) AS n FROM pairs p JOIN sums s ON s.doc_id = p.doc_id AND s.line BETWEEN p.i AND p.j GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, n ORDER BY doc_id, i) AS r FROM named) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS line FROM later),
per AS (SELECT doc_id, count(*) AS n_deleted FROM gone GROUP BY 1),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) AS t FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY 1)
SELECT d.doc_id, len(d.ls)::INT AS n_lines, coalesce(n_deleted, 0)::INT AS n_deleted, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""
