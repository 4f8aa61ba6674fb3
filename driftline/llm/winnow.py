"""Document fingerprints by winnowing, in DataFrame functions only.

Units are runs of up to 16 letters or digits of the scripts that put blanks between words, and single
other characters, so that texts without blanks have units too. A gram is the rolling hash of five
consecutive units; of every eight consecutive grams the least is chosen, the rightmost among equals,
with its position. Two texts that share twelve consecutive units so share a chosen gram.

The rolling hash is the cyclic polynomial: the exclusive or of the units' hashes, each turned left by as
many bits as units follow it in the gram; the next gram's comes from it by a turn and two exclusive ors.
Column functions keep no running state, so it is written out at every place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.common import constants, let

POSITIONS = 1 << 31
#: Lower-case Latin, Greek, Cyrillic and the other alphabets with blanks between words; then all else but white space.
UNIT = r"[a-z0-9\u00c0-\u024f\u0300-\u0dff\u10a0-\u177f\u1800-\u1fff]{1,16}|[^\s\p{Z}]"


def chosen(text: Column, k: int = 5, window: int = 8) -> Column:
    """Array of (hash << 31 | 2^31 - 1 - position), in order of position; hashes have 32 bits.

    A text of fewer than ``k`` units has one gram of all its units, one without units none; fewer
    grams than ``window`` form one window.
    """

    def turned(x: Column, by: int) -> Column:
        return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x

    def placed(hash_: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(hash_, 32), 31) + (F.lit(POSITIONS - 1) - i)

    def grams(h: Column) -> Column:
        n = F.size(h)
        roll = lambda i: reduce(lambda a, b: a.bitwiseXOR(b), [turned(F.get(h, i + j), k - 1 - j) for j in range(k)])
        many = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: placed(roll(i), i))
        return F.when(n >= k, many).when(n > 0, F.array(placed(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<long>"))

    def minima(g: Column) -> Column:
        wide = F.size(g) - (window - 1)
        least = F.transform(F.sequence(F.lit(1), F.greatest(wide, F.lit(1))), lambda i: F.array_min(F.slice(g, i, window)))
        return F.when(F.size(g) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))

    hashed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w))
    return let(let(hashed, grams), minima)


def written(chosen_: Column) -> Column:
    """``hash@position`` in hexadecimal, joined by blanks."""
    one = lambda c: F.concat(F.lower(F.hex(F.shiftright(c, 31))), F.lit("@"), F.lower(F.hex(F.lit(POSITIONS - 1) - c.bitwiseAND(POSITIONS - 1))))
    return F.array_join(F.transform(chosen_, one), " ")


def hashes(chosen_: Column) -> Column:
    return F.array_distinct(F.transform(chosen_, lambda c: F.shiftright(c, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)),
    )


def _part(cuts: list[int], block: int = 256) -> Column:
    """How many of the sorted cuts are less than the id (null: none), by blocks of cuts."""
    if not cuts:
        return F.lit(0)
    id_, marks, coarse = F.col("doc_id"), F.array(*[F.lit(x) for x in cuts]), cuts[block - 1 :: block]
    less = lambda m: m < id_
    if not coarse:
        return F.coalesce(F.size(F.filter(marks, less)), F.lit(0))
    whole = F.size(F.filter(F.array(*[F.lit(x) for x in coarse]), less))
    return F.coalesce(let(whole, lambda c: c * block + F.size(F.filter(F.slice(marks, c * block + 1, block), less))), F.lit(0))


def _with_next(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, part, flag): ranges of about ``rows`` ids, the first row of the next range added
    to each with flag 1. Ranges are cut at quantiles of the ids; the texts are shuffled once, and of
    each range only the first row is read again."""
    n = docs.count()
    ranges = min(65_536, -(-n // rows))
    cuts = []
    if ranges > 1:
        at = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        cuts = sorted(set(docs.select(F.percentile_approx("doc_id", at, 20 * ranges)).first()[0] or []))
    placed = docs.withColumn("part", _part(cuts).cast("int"))
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))).alias("k"))
    found = sorted(firsts.select("part", "k.doc_id", "k.h").collect(), key=lambda r: r["part"])
    goes = [(b["doc_id"], b["h"], a["part"]) for a, b in zip(found, found[1:] + found[:1])]
    listed = constants(docs.sparkSession, goes, "i long, h long, part int")  # one row a range
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h"))
    extra = docs.join(F.broadcast(listed), same).select("doc_id", "text", "part").dropDuplicates(["part"])
    return placed.withColumn("flag", F.lit(0)).unionByName(extra.withColumn("flag", F.lit(1)))


def fingerprint_documents(docs: DataFrame, k: int = 5, window: int = 8, rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (see ``edited`` below), and how alike
    the text's is to the edited text's and to the next document's.

    The next document is the one of the next greater doc_id (equal ids: of the greater text hash;
    null ids first), after the last one the first. Null texts are empty, an empty text has an empty
    fingerprint, two empty fingerprints are alike to 1.0. Whole texts are read, however long; rows of
    equal id and text are neighbours in any order. Rows of one id (or of none) are in one range, which is
    read by one task. A table of one row is its own next
    document; an empty table gives no rows; other columns are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    follow = W.partitionBy("part").orderBy("flag", "doc_id", F.xxhash64("text"))
    print_ = chosen(F.col("text"), k, window)
    rows = (
        _with_next(plain, rows)
        .withColumn("next_text", F.lead("text").over(follow))
        .withColumn("f", print_)
        .withColumn("next_f", F.lead("f").over(follow))
        .where("flag = 0")
    )
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    # edited: the last quarter of the code points gives way to the first as many (or all) of the next text
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "f", "next_f")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "f", chosen(F.col("edited"), k, window).alias("e"), "next_f")
    rows = rows.withColumns({"hf": hashes(F.col("f")), "he": hashes(F.col("e")), "hn": hashes(F.col("next_f"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("f")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("hf"), F.col("he")).alias("near_edited"), likeness(F.col("hf"), F.col("hn")).alias("near_next"),
    )
