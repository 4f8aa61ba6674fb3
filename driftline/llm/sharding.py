"""Minimax contiguous partition of ordered atomic groups into a fixed number of shards.

Groups (equal texts) are ordered: as many of the largest as there are shards come first, by falling
size, then all others by a 64-bit hash. The smallest feasible shard capacity is found by binary search; a
capacity is feasible if a greedy fill in that order needs no more than the given shards. While the
first shard so found ends among the largest groups, it is cut there and the search starts again on what
is left, so one group that is larger than all shards should be decides no other shard's size.

The search runs over bounded summaries: the hash order is cut into dyadic cells, and only the cells in
which some cut can still fall are split further, until every cut is exact. The driver so holds some ten
thousand sums at most, however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, spread_rank

FIRST_BITS, STEP_BITS = 12, 6


def _walk(prefix: list[int], atomic: list[bool], capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Ends (in bytes from the start) of a greedy fill; inside an unsplit cell it stops at the cell's
    start, or, if hopeful, at the very byte."""
    ends, at, total = [], 0, prefix[-1]
    for _ in range(shards):
        reach = at + capacity
        if reach >= total:
            at = total
        else:
            j = bisect_right(prefix, reach) - 1
            at = reach if hopeful and not atomic[j] else max(at, prefix[j])
        ends.append(at)
    return ends


def _least(prefix, atomic, shards, hopeful) -> int:
    total = prefix[-1]
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        if _walk(prefix, atomic, mid, shards, hopeful)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


@dataclass(frozen=True)
class Cell:
    """Consecutive groups: their place in the order, bytes and number; ``of`` is the cell's hash prefix of
    ``bits`` bits, or -1 for one of the largest groups."""

    place: tuple[int, int]
    bytes: int
    groups: int
    of: int
    bits: int


def _search(have: list[Cell], shards: int, split) -> tuple[list[Cell], list[int]]:
    """The cells, split as far as the cuts need, and the index of the first cell after each shard."""
    while True:
        prefix = [0, *accumulate(x.bytes for x in have)]
        atomic = [x.groups == 1 or x.bits >= 64 for x in have]
        low, high = _least(prefix, atomic, shards, True), _least(prefix, atomic, shards, False)
        floor, top = _walk(prefix, atomic, low, shards, False), _walk(prefix, atomic, high, shards, True)
        open_ = set()
        for a, b in zip(floor, top):
            i = max(0, bisect_right(prefix, a) - 1)
            while i < len(have) and prefix[i] < b:
                if not atomic[i]:
                    open_.add(i)
                i += 1
        if not open_:
            return have, [bisect_right(prefix, e) - 1 for e in _walk(prefix, atomic, high, shards, False)]
        new = [y for bits in {have[i].bits for i in open_} for y in split(bits, [have[i].of for i in open_ if have[i].bits == bits])]
        have = sorted([x for i, x in enumerate(have) if i not in open_] + new, key=lambda x: x.place)


def minimax_partition(groups: DataFrame, shards: int) -> tuple[dict[int, int], int, list[int]]:
    """The partition of groups (h long, g long): the shards of the largest groups by hash; the shard in which
    the others begin; the first hash of every shard after that one."""
    largest = groups.orderBy(F.desc("g"), "h").limit(shards).collect()
    head = [Cell((0, i), r["g"], 1, -1, 64) for i, r in enumerate(largest)]
    others = groups.where(~F.col("h").isin([r["h"] for r in largest])) if largest else groups

    def cells(bits: int, inside: list[int] | None, of_bits: int) -> list[Cell]:
        part = others if inside is None else others.where(F.shiftright("h", 64 - of_bits).isin(inside))
        rows = part.groupBy(F.shiftright("h", 64 - bits).alias("c")).agg(F.min("h").alias("lo"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).collect()
        return [Cell((1, r["lo"]), r["g"], r["n"], r["c"], bits) for r in rows]

    have = head + sorted(cells(FIRST_BITS, None, 0), key=lambda x: x.place)
    done, starts = 0, []  # shards that are cut for good, and the places where shards start
    while have and done < shards:
        have, ends = _search(have, shards - done, lambda bits, inside: cells(min(64, bits + STEP_BITS), inside, bits))
        firsts = [0, *ends[:-1]]
        if have[0].of == -1 and 0 < ends[0] < len(have) and have[ends[0] - 1].of == -1 and shards - done > 1:
            firsts = firsts[:1]
        starts += [have[i].place if i < len(have) else (2, 0) for i in firsts]
        if len(firsts) > 1 or ends[0] >= len(have):
            break
        have, done = have[ends[0] :], done + 1
    of = lambda place: bisect_right(starts, place) - 1
    later = [h for kind, h in starts if kind == 1]
    begins = of((1, -(1 << 63) - 1)) if starts else 0
    return {r["h"]: of((0, i)) for i, r in enumerate(largest)}, begins, later


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Law ``bytes``: every row gets a shard such that the largest shard is as small as can be.

    Equal texts stay together (as do texts of one 64-bit hash), so a shard is never smaller than its
    largest group. Null texts count as empty; repeated rows and null ids are rows like any other; slots
    follow a hash of id and text, ties by these; long texts count with all their bytes; an empty table
    gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        )
    )
    groups = cut(base.groupBy("h").agg(F.sum("size").alias("g")))
    rows = base.count()
    largest, begins, firsts = minimax_partition(groups, shards)
    shard = F.lit(begins)
    for first in firsts:
        shard = shard + (F.col("h") >= F.lit(first)).cast("int")
    for h, i in largest.items():
        shard = F.when(F.col("h") == F.lit(h), F.lit(i)).otherwise(shard)
    dealt = base.withColumn("shard", shard.cast("int"))
    ranked = spread_rank(dealt, ["shard"], ["doc_id", "h"], "slot", max(8, rows // (shards * 20_000)))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
