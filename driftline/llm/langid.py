"""Language identification: known words by per-language log frequency, unseen words by backing off to
progressively shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import forget, held, small_batches

RUNS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case. Fractions, superscripts, circled and Roman numerals,
    which a pattern for word characters takes, are no letters and part words."""
    if not isinstance(text, str):
        return []
    found = RUNS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class WordBackoff:
    """Tables of one fitted model; bounded by the texts it was fitted on."""

    def __init__(self, counts: dict[str, dict[str, int]], longest: int = 4):
        self.langs = sorted(counts)
        self.longest = longest
        vocabulary = sorted({w for c in counts.values() for w in c})
        self.rows = {w: i for i, w in enumerate(vocabulary)}
        times = np.zeros((len(vocabulary), len(self.langs)))
        for j, lang in enumerate(self.langs):
            for w, n in counts[lang].items():
                times[self.rows[w], j] = n
        self.table = np.log((times + 0.5) / (times.sum(axis=0) + 0.5 * len(vocabulary))) if vocabulary else times
        #: Per length the row of an n-gram, and the table of log frequencies.
        self.grams: dict[int, tuple[dict[str, int], np.ndarray]] = {}
        for n in range(1, longest + 1):
            at: dict[str, int] = {}
            has = np.array([max(0, len(w) + 3 - n) for w in vocabulary], dtype=np.int64)
            grams = np.fromiter((at.setdefault(g, len(at)) for w in vocabulary for g in self._cut(w, n)), dtype=np.int64, count=has.sum())
            if at:
                word = np.repeat(np.arange(len(vocabulary)), has)
                matrix = np.stack([np.bincount(grams, times[word, j], len(at)) for j in range(len(self.langs))], axis=1)
                whole = matrix.sum(axis=0) + 0.5 * len(at)
                self.grams[n] = at, np.log((matrix + 0.5) / whole)
                if n == 3:  # the last row is for trigrams that were never seen
                    self.threes = np.vstack([self.grams[n][1], np.log(0.5 / whole)])
        #: Of every word of the table the sum of its trigrams' log frequencies.
        self.fits = self._fits(vocabulary)

    @staticmethod
    def _cut(word: str, n: int) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    def _fits(self, words: list[str]) -> np.ndarray:
        """Sum over each word's trigrams of their log frequencies; trigrams never seen count as half an
        occurrence. A word has as many trigrams as letters."""
        if not words or 3 not in self.grams:
            return np.zeros((len(words), len(self.langs)))
        get = self.grams[3][0].get
        at = np.fromiter((get(g, -1) for w in words for g in self._cut(w, 3)), dtype=np.int64)
        starts = np.cumsum([0, *map(len, words)])[:-1]
        return np.add.reduceat(self.threes[at], starts, axis=0)

    def unseen(self, word: str) -> np.ndarray | None:
        """Mean log frequency of the longest n-grams of the word that are known at all."""
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            at, table = self.grams.get(n, ({}, None))
            known = [i for g in self._cut(word, n) if (i := at.get(g)) is not None]
            if known:
                return table[known].mean(axis=0)
        return None


class Scorer:
    """Applies a model to whole texts; remembers unseen words within a bound."""

    def __init__(self, model: WordBackoff, remember: int = 50_000):
        self.model, self.remember = model, remember
        self.reset()

    def reset(self, room: int = 0) -> None:
        """Forgets the unseen words; their rows follow those of the model's tables."""
        n, size = len(self.model.table), len(self.model.langs)
        more = np.zeros((max(self.remember, room), size))
        self.rows = dict(self.model.rows)
        self.table, self.fits = np.vstack([self.model.table, more]), np.vstack([self.model.fits, more])
        self.used = n

    def _learn(self, words: set[str]) -> None:
        new, at = list(words), self.used
        for i, w in enumerate(new, at):
            known = self.model.unseen(w)
            self.table[i] = 0.0 if known is None else known
            self.rows[w] = i
        if new:
            self.fits[at : at + len(new)] = self.model._fits(new)
        self.used += len(new)

    def _rows(self, words: list[str]) -> np.ndarray:
        """The rows of a text's words in the tables."""
        try:
            return np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            pass
        missing = {w for w in words if w not in self.rows}
        if self.used + len(missing) > len(self.table):  # no room: of the unseen words only this text's are kept
            missing = {w for w in words if w not in self.model.rows}
            self.reset(len(missing))
        self._learn(missing)
        return np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))

    def one(self, text) -> tuple[str, float, int, float, int]:
        """Best language and its share, and its number, how well the text fits it (sum over trigrams) and the
        number of trigrams; ``und`` without a letter or a language."""
        words = words_of(text)
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0, -1, 0.0, 0
        at = self._rows(words)
        mean = self.table[at].mean(axis=0)
        share = np.exp(mean - mean.max())
        best = int(share.argmax())
        return self.model.langs[best], float(share[best] / share.sum()), best, float(self.fits[at, best].sum()), sum(map(len, words))

    def batch(self, texts) -> tuple[list[str], list[float]]:
        """Best language and its share of each text."""
        got = [self.one(t) for t in texts]
        return [g[0] for g in got], [g[1] for g in got]

    def fit(self, text, lang: str) -> float | None:
        """Mean log frequency of the text's trigrams in ``lang``, whatever the other languages say; None without
        a letter or for a language that the model does not know."""
        words = words_of(text)
        if not words or lang not in self.model.langs:
            return None
        at = self._rows(words)  # may make new tables
        return float(self.fits[at, self.model.langs.index(lang)].sum() / sum(map(len, words)))


def _sample(docs: DataFrame, text_col: str, lang_col: str, max_docs: int) -> tuple[dict[str, int], DataFrame | None]:
    """Distinct texts a language, about, and the rows (l, t) of about ``max_docs`` of them each."""
    keyed = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    have = {r["l"]: r["n"] for r in keyed.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n")).collect()}
    if not have:
        return {}, None
    # the texts of least hash, by the share of a language's texts that max_docs is
    most = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, max_docs / max(1, n)))])
    place = F.shiftrightunsigned(F.xxhash64("t"), 11).cast("double") / float(2**53)
    return have, keyed.where(place < F.element_at(most, F.col("l"))).dropDuplicates(["l", "t"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 1000, longest: int = 4) -> WordBackoff:
    """Fit on a bounded sample: about ``max_docs`` distinct whole texts a language, those of the least
    hash, with all their words. Rows without text or language are not used; with no usable row the model
    knows no language."""
    small_batches(docs.sparkSession)
    have, sample = _sample(docs, text_col, lang_col, max_docs)
    if not have:
        return WordBackoff({}, longest)

    def count(batches):
        forget()
        tally: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["l"], pdf["t"]):
                tally.update((lang, w) for w in words_of(text))
            if len(tally) > 100_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in tally.items()], columns=["l", "w", "n"])
                tally.clear()
        if tally:
            yield pd.DataFrame([(a, b, n) for (a, b), n in tally.items()], columns=["l", "w", "n"])

    words = sample.mapInPandas(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in have}
    for r in words.toLocalIterator():  # the words of the sample
        counts[r["l"]][r["w"]] = r["n"]
    return WordBackoff({k: v for k, v in counts.items() if v}, longest)


def predictor(spark, model: WordBackoff):
    """A column function of the text alone: struct<lang string, score double>."""
    shared, key = spark.sparkContext.broadcast(model), uuid4().hex

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = held(("scorer", key), lambda: Scorer(shared.value)).batch(texts)
        return pd.DataFrame({"lang": langs, "score": scores})

    return predict


def predict_languages(train: DataFrame, docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """``docs`` with ``__lang`` (``und`` for null texts and texts without a letter) and ``__score``.

    The score is the softmax share of the best language over mean word scores; letters are those of
    Unicode, so texts of fractions or circled numerals have none. Whole texts are read, a bounded number
    at once. Repeated rows get equal answers; ties go to the lesser language code; an empty table gives
    no rows; other columns pass.
    """
    predict = predictor(docs.sparkSession, fit(train, text_col=text_col, **params))
    told = docs.withColumn("__p", predict(F.col(text_col)))
    return told.withColumn("__lang", F.col("__p.lang")).withColumn("__score", F.col("__p.score")).drop("__p")


def own_fits(docs: DataFrame, model: WordBackoff, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(l, h, f) of the labelled rows: language, hash of the text, and how the text fits it (null: nohow)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid4().hex
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def own(texts: pd.Series, langs: pd.Series) -> pd.Series:
        scorer = held(("scorer", key), lambda: Scorer(shared.value))
        return pd.Series([scorer.fit(t, lang) for t, lang in zip(texts, langs)], dtype="float64")

    keyed = docs.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null")
    # nondeterministic, so that Spark does not make the fit once for a filter and once more for its value
    return keyed.select("l", F.xxhash64("t").alias("h"), own.asNondeterministic()("t", "l").alias("f"))


def usual_fits(docs: DataFrame, model: WordBackoff, text_col: str = "text", lang_col: str = "lang", least_slack: float = 3.0) -> dict[str, tuple[float, float]]:
    """Per language the median fit of all distinct labelled texts, to three digits, and the cut under which a
    text is not in it: twenty times as far below the median as the lower quartile is, and ``least_slack`` at
    least; so a few wrongly labelled texts do not move it. Fits are counted by value, so no task holds all."""
    told = own_fits(docs, model, text_col, lang_col).where("f is not null and not isnan(f)")
    counts = told.groupBy("l", "h").agg(F.first("f").alias("f")).groupBy("l", F.round("f", 3).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    at = lambda p: F.percentile("f", F.lit(p), F.col("n"))
    rows = counts.groupBy("l").agg(at(0.5).alias("mid"), at(0.25).alias("low")).collect()
    return {r["l"]: (r["mid"], r["mid"] - max(least_slack, 20 * (r["mid"] - r["low"]))) for r in rows}


def judge(spark, model: WordBackoff, usual: dict[str, tuple[float, float]], prior: int = 10):
    """A column function of the text alone: struct<lang string, score double, fits boolean>; ``fits`` says
    whether the text's fit reaches the cut of its language. Short texts are drawn to the median by
    ``prior`` trigrams."""
    shared, key = spark.sparkContext.broadcast(model), uuid4().hex

    @F.pandas_udf("lang string, score double, fits boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        scorer, out = held(("scorer", key), lambda: Scorer(shared.value)), []
        for lang, score, _, total, letters in map(scorer.one, texts):
            mid, cut = usual.get(lang, (0.0, float("inf")))
            out.append((lang, score, (total + mid * prior) / (letters + prior) >= cut))
        return pd.DataFrame(out, columns=["lang", "score", "fits"])

    return told
