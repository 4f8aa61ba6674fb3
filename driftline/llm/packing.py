"""Packing tokenised documents: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import by_bytes, cut, held, small_batches, spread_rank


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (packs, [(length, times), ...]); lengths are placed longest first, each document
    into the shortest open pack that it fits, else into a new one. Counts are moved, not documents,
    so the work depends on the number of lengths alone."""
    free: dict[int, list[tuple[int, tuple]]] = {}
    heap: list[int] = []
    full: list[tuple[int, tuple]] = []

    def put(space: int, packs: int, pattern: tuple) -> None:
        if space <= 0:
            full.append((packs, pattern))
            return
        if not free.get(space):
            free[space] = []
            heapq.heappush(heap, -space)
        free[space].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0] >= length:
            space = -heap[0]
            packs, pattern = free[space].pop()
            if not free[space]:
                heapq.heappop(heap)
            moved = min(packs, left)
            if moved < packs:
                put(space, packs - moved, pattern)
            put(space - length, moved, (pattern, length, 1))
            left -= moved
        if left:
            times = capacity // length
            if whole := left // times:
                put(capacity - times * length, whole, (None, length, times))
            if rest := left % times:
                put(capacity - rest * length, 1, (None, length, rest))
    out = []
    for packs, pattern in full + [x for space in sorted(free) for x in free[space]]:
        items: list[list[int]] = []
        while pattern is not None:
            pattern, length, times = pattern
            if items and items[-1][0] == length:
                items[-1][1] += times
            else:
                items.append([length, times])
        out.append((packs, [(a, b) for a, b in reversed(items)]))
    return out


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each run of equal lengths in a pattern the ranks of documents it takes, and where they go."""
    taken: Counter = Counter()
    rows, first = [], 0
    for packs, items in patterns:
        at = 0
        for length, times in items:
            rows.append((length, taken[length], taken[length] + packs * times - 1, first, times, at))
            taken[length] += packs * times
            at += length * times
        first += packs
    return pd.DataFrame(rows, columns=["p_length", "p_from", "p_to", "p_first", "p_times", "p_at"], dtype="int64")


#: Chunks of these characters are lowered and split here as the tokenizer would; others go to it whole.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: What no text of plain chunks alone has.
ODD = re.compile(r"[^ \n!-~À-ÖØ-öø-ÿ]")
# Fixed value: the tokenizer's own split, on lowered text of plain chunks.
SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]+")


def byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: as its own character where that is visible, else as
    the next unused one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(spare)) for b in range(256)}


class Recent(dict):
    """Answers of ``make`` for strings of up to 48 characters: those asked for since the last ``turn`` and,
    until the next one, those of the turn before."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.before.get(key)) is None:
            value = self.make(key)
        if len(key) <= 48:
            self[key] = value
        return value

    def turn(self, most: int) -> None:
        """Where there are more than ``most`` new ones, the older ones go."""
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class WordTokens:
    """Token ids of texts as little-endian bytes; words are remembered within a bound, and so are
    blank-separated chunks of texts with characters that are not plain.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks,
    and those of its words where all chunks are plain.
    """

    def __init__(self, spec: str, remember: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model, self.remember = self.tokenizer.model, remember
        #: Strings that stand for tokens of their own; chunks that hold one go to the tokenizer.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = byte_characters()
        self.written = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(256)}
        self.words, self.chunks = Recent(self._word), Recent(self._chunk)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and not self._has_special(chunk):
            return self._plain(chunk)
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.translate(self.written))])

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        self.words.turn(self.remember)
        self.chunks.turn(self.remember // 4)
        if not (ODD.search(text) or self._has_special(text)):
            return self._plain(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids cut every ``capacity`` ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    end = end_id.to_bytes(4, "little")
    small_batches(docs.sparkSession)

    def cut_up(batches):
        words = held(("words", key), lambda: WordTokens(shared.value))
        for batch in by_bytes(batches, 1):
            of, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    of.append(i)
                    start.append(a)
                    length.append(min(capacity, n - a))
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + capacity)]))
                    total.append(n)
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *numbers], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(cut_up, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every token of every row in exactly one piece of one sequence of at most ``capacity`` tokens.

    Documents are cut at multiples of ``capacity``; the lengths of the pieces form a histogram of at
    most ``capacity`` rows, which the driver packs; patterns are joined back by each piece's rank among
    the pieces of its length. Whole texts are tokenised, however long; the tokenizer's special strings
    in a text are its special tokens. Null and empty texts are the end token alone; repeated rows are
    packed each; pieces of equal length change places only among themselves (order: doc_id, start,
    checksum); an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = places(pack_histogram(histogram, capacity))
    if plan.empty:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    where = spark.createDataFrame(plan)
    if len(plan) <= 200_000:  # some runs for each length; else it is joined by a shuffle
        where = F.broadcast(where)
    ranked = spread_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "__rank", max(4, sum(histogram.values()) // 50_000))
    x = F.col("__rank") - F.col("p_from")
    placed = ranked.join(where, (F.col("length") == F.col("p_length")) & F.col("__rank").between(F.col("p_from"), F.col("p_to")))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("p_first") + F.floor(x / F.col("p_times"))).cast("long").alias("sequence_id"),
        (F.col("p_at") + (x % F.col("p_times")) * F.col("length")).cast("long").alias("offset"),
    )
