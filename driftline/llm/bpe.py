"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece the table keeps the one token that ends its encoding. A token fits at the
end of a prefix exactly if it and the last token of the rest stay apart when the two are encoded
together, so one pass over the bytes finds every entry. Appends extend the table; an edit keeps the
entries before it and, once the table agrees with the old one again, the entries after it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import by_bytes, held, small_batches

INFINITE = 1 << 60
#: A blank between white space on both sides (or the end): only there can a match span two chunks.
SPANS = re.compile(r"\s (?:\s|\Z)")


class Vocabulary:
    """Ranks of byte strings, each token's last merge and which pairs of tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable: dict[bytes, int] = {}
        for t, i in ranks.items():
            if len(t) == 1:
                self.reachable[t] = i
            elif len(two := self._merge(t, i)) == 2:
                self.parts[i] = (ranks[two[0]], ranks[two[1]])
                self.reachable[t] = i
        self._apart: dict[int, bool] = {}
        #: Finds the tokens that end at each byte, longest first; bytes stand as the first 256 characters.
        self.ends = ahocorasick.Automaton()
        for t, i in self.reachable.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        if self.reachable:
            self.ends.make_automaton()

    @classmethod
    def read(cls, lines: bytes) -> Vocabulary:
        pairs = (x.split() for x in lines.splitlines() if x.strip())
        return cls({base64.b64decode(a): int(b) for a, b in pairs})

    def _merge(self, text: bytes, below: int) -> list[bytes]:
        """The parts of ``text`` after all merges of a rank less than ``below``."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], INFINITE), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether adjacent tokens a, b remain two tokens. Going back in time, the later-made of the
        two is undone; whenever the pair that then touched could merge before either was swallowed,
        the boundary would have gone. Equal ranks merge from the left."""
        key = a << 32 | b
        if (known := self._apart.get(key)) is not None:
            return known
        gone_a = gone_b = INFINITE
        result = None
        while result is None:
            rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if rank is not None and rank < gone_a and rank <= gone_b:
                result = False
                break
            made_a = a if a in self.parts else -1
            made_b = b if b in self.parts else -1
            if made_a < 0 and made_b < 0:
                result = True
            elif made_a > made_b:
                gone_a, a = made_a, self.parts[a][1]
            else:
                gone_b, b = made_b, self.parts[b][0]
        if len(self._apart) > 1_000_000:
            self._apart.clear()
        self._apart[key] = result
        return result


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def _fill(self, text: bytes, start: int, stop: int):
        """Entries for prefixes of start + 1 to stop bytes, one after another."""
        v, last, known = self.vocabulary, self.last, self.vocabulary._apart.get
        back = max(0, start - v.longest)
        done = start
        for end, (t, n) in v.ends.iter(text[back:stop].decode("latin-1")):
            end += back
            if end != done:
                continue
            if n <= end:
                before = last[end - n]
                if (ok := known(before << 32 | t)) is None:
                    ok = v.apart(before, t)
                if not ok:
                    continue
            elif n > end + 1:
                continue
            last.append(t)
            done += 1
            yield done
        if done < stop:
            raise ValueError("a byte of the text is not in the vocabulary")

    def append(self, more: bytes) -> None:
        text = self.text + more
        for _ in self._fill(text, len(self.text), len(text)):
            pass
        self.text = text

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of [start, stop); returns how many entries were computed anew."""
        old, shift = self.last, len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        self.last, same, at = old[:start], 0, start
        if start + len(new) < len(text) or new:
            for at in self._fill(text, start, len(text)):
                same = same + 1 if at > start + len(new) and self.last[-1] == old[at - 1 - shift] else 0
                if same >= self.vocabulary.longest and at < len(text):  # no token reaches back over so many equal entries
                    self.last.extend(old[at - shift :])
                    break
        self.text = text
        return at - start

    def tokens(self) -> list[int]:
        out, i = [], len(self.last)
        while i:
            out.append(t := self.last[i - 1])
            i -= len(self.vocabulary.bytes_of[t])
        return out[::-1]


class _Memory(dict):
    """Answers of ``make``, remembered for keys of a length up to ``longest``."""

    def __init__(self, make, longest: int = 64):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value


class Encoder:
    """Encodes whole texts; remembers pieces and blank-separated chunks within a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, remember: int = 200_000):
        self.vocabulary, self.find, self.remember = vocabulary, regex.compile(pattern).findall, remember
        self.pieces = _Memory(self._piece)
        self.chunks = _Memory(lambda c: self._pieces(" " + c))

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(raw)
        return (whole,) if whole is not None else tuple(PrefixTable(self.vocabulary, raw).tokens())

    def _pieces(self, text: str) -> tuple[int, ...]:
        found = self.find(text)
        return self.pieces[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        for memory in (self.pieces, self.chunks):
            if len(memory) > self.remember:
                memory.clear()
        if SPANS.search(text):
            return list(self._pieces(text))
        head, *rest = text.split(" ")
        out = list(self._pieces(head))
        out.extend(chain.from_iterable(map(self.chunks.__getitem__, rest)))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Every match of ``pattern`` in the whole text is encoded by itself, without special tokens; then
    the ids are decoded. Whole texts are encoded, a bounded number of bytes at once. Null and empty texts
    have no token; repeated rows repeat; a text has one encoding, so there are no ties; an empty table
    gives no rows; other columns are not read. The rank file is read by the driver and broadcast
    (its size does not depend on the documents).
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), (hashlib.sha256(ranks).hexdigest(), pattern)

    def encode(batches):
        encoder = held(("bpe", *key), lambda: Encoder(Vocabulary.read(shared.value), pattern))
        decimal = [""] * (max(encoder.vocabulary.bytes_of, default=-1) + 1)
        for i in encoder.vocabulary.bytes_of:
            decimal[i] = str(i)
        for batch in by_bytes(batches, 1):
            n, sha, back = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
