"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing
names, for every operator."""

import weakref

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as public
from driftline.llm import ann, bpe, common, dartminhash, langid, licenses, linedup, packing, quality, sharding, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, n int, line int, seg int, part int, flag int, bands int, rep int, pos int, comp int, length int"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
ROWS = [
    (None, "a text without an id", "en"), (1, None, "en"), (2, "", None), (3, "   \n \n", "de"), (4, "one", "en"), (5, "12345 !!! ---", "fr"),
    (6, LONG, "en"), (7, "the same words again and again in a text", "en"), (7, "the same words again and again in a text", "en"),
    (8, "the same words again and again in a text", "fr"), (9, "日本語のテキスト 🙂", None), (10, "x" * 5000, "en"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, g, None, None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) for i, t, g in rows], SCHEMA)


def labels(spark, rows=((4, 1, 0), (7, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


WORDS, RANKS = public.path("word_bpe_49k.json"), public.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "linedup": lambda s, d: linedup.delete_later_copies(d, 5),
    "quality": lambda s, d: quality.resample(d, labels(s)),
    "sharding": lambda s, d: sharding.shard_documents(d, 4),
    "packing": lambda s, d: packing.pack_documents(d, WORDS),
    "dartminhash": lambda s, d: dartminhash.near_duplicate_classes(d),
    "winnow": lambda s, d: winnow.fingerprint_documents(d, rows=3),
    "bpe": lambda s, d: bpe.encode_documents(d, RANKS, public.PATTERN),
    "langid": lambda s, d: langid.predict_languages(d, d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, docs(spark)).collect()
    ids = [r["doc_id"] for r in got]
    if name == "packing":  # some texts need several sequences
        assert set(ids) == {r[0] for r in ROWS} and len(ids) >= len(ROWS)
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7 + 1), float(i % 3), 1.0], 0) for i in range(100)] + [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [nan, 1.0, 1.0], 0), (103, [inf, 1.0, 1.0], 0), (104, [None, 1.0, 1.0], 0), (105, [1.0], 0), (None, [1.0, 1.0, 1.0], 0), (20, [3.0, 3.0, 9.0], 0)]
    e = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, part int, v int, score int")
    got = ann.search(e, e.where("vec_id % 20 = 0"), k=5).collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 60, 80}
    assert all(r["vec_id"] != r["query_id"] and r["vec_id"] < 100 for r in got)
    empty = e.where("false")
    assert ann.search(empty, empty).collect() == []
    few = e.where("vec_id in (0, 1, 2)")
    assert [r["vec_id"] for r in ann.search(few, few.where("vec_id = 0"), k=20).orderBy("rank").collect()] == [2, 1]


def test_pipeline_odd_rows(spark, tmp_path):
    docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 7 in {r["doc_id"] for r in got} and not {2, 3, 5} & {r["doc_id"] for r in got}


def test_null_texts_are_defined(spark):
    d = docs(spark)
    lang = {r["doc_id"]: r["__lang"] for r in langid.predict_languages(d, d).collect()}
    assert lang[1] == lang[2] == lang[5] == "und"
    packed = {r["doc_id"]: r["doc_tokens"] for r in packing.pack_documents(d, WORDS).collect()}
    assert packed[1] == packed[2] == packed[3] == 1
    w = {r["doc_id"]: r for r in winnow.fingerprint_documents(d).collect()}
    assert w[1]["fingerprint"] == "" and w[1]["n_chars"] == 0
    near = dartminhash.near_duplicate_classes(d).where("doc_id in (7, 8)").select("class_id", "class_size", "keeps").collect()
    assert {r["class_id"] for r in near} == {7} and {r["class_size"] for r in near} == {3} and sum(r["keeps"] for r in near) == 1
    assert dartminhash.one_of_each(d).where("doc_id in (7, 8)").count() == 1
    assert {r["doc_id"]: r["canonical_sha256"] for r in licenses.scan_licenses(d).collect()}[1] is None


def test_line_runs(spark):
    run = "first line of some words\nsecond line of some words"
    d = spark.createDataFrame([(1, f"{run}\nown one"), (2, f"own two\n{run}\nown three"), (3, "first line of some words\nother"), (4, f"{run}\n{run}")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linedup.delete_later_copies(d, 8).collect()}
    assert got == {1: f"{run}\nown one", 2: "own two\nown three", 3: "first line of some words\nother", 4: ""}


def test_whole_licences(spark):
    texts = dict(licenses.full_texts()[::-1])
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense", "BSL-1.0", "Zlib"} <= set(texts)
    names = sorted(texts)
    rows = [(i, texts[n].upper(), None) for i, n in enumerate(names)] + [(100, "Own words.\n" + texts["GPL-3.0"], None)]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {**dict(enumerate(names)), 100: None}


def test_licence_wordings_that_tie(spark):
    known = [("B", "Same words, here."), ("A", "same WORDS here"), ("C", "other")]
    rows = [(1, "SAME words -- here!", None), (2, "other\nCopyright (c) 2020 Someone", None), (3, "other words", None), (3, "other", None), (3, "other", None)]
    got = sorted((r["doc_id"], r["license_id"] or "") for r in licenses.scan_licenses(docs(spark, rows), known).collect())
    assert got == [(1, "A"), (2, "C"), (3, ""), (3, "C"), (3, "C")]


def test_ann_ties_and_repeated_ids(spark):
    """Ties at the last rank go to the smaller id; of one id's vectors the best counts."""
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(i % 2)]) for i in range(1, 40)] + [(50, [0.1, 0.0]), (50, [0.9, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.search(e, e.where("vec_id = 0"), k=20).orderBy("rank").collect()]
    assert got == [(50, 0.9)] + [(i, 0.5) for i in range(1, 20)]


def test_language_ties_go_to_the_lesser_code(spark):
    d = docs(spark, [(1, "same words", "fr"), (2, "same words", "de"), (3, "same", None)])
    assert {r["__lang"] for r in langid.predict_languages(d, d).collect()} == {"de"}


def test_pipeline_empty_table(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    """All stages but the last return the columns they were given, with the values of the rows they keep."""
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    d = docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, str(tmp_path))
        assert got.columns == d.columns, name
        assert {(r["size"], r["h"], r["rep"], r["length"]) for r in got.collect()} <= {(1, 2, 9, 12)}, name


def test_line_dedup_estimates_stay_small(spark):
    """Nine rounds of joins do not multiply the plan's estimate of its bytes, which the driver holds as one number."""
    d = docs(spark, [(i, "\n".join(f"{i}" if j == 300 else f"line {j}" for j in range(301)), None) for i in (1, 2)])
    shared = linedup._shared_lines(linedup._texts(d, "doc_id", "text"), 5)
    runs = linedup.later_runs(shared)
    assert runs.agg(F.max("n")).first()[0] == 300
    assert runs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**400


def test_usual_fits_are_of_all_labelled_texts(spark):
    """The median fit is that of all 2,400 distinct texts of a language; copies count once."""
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i * j % 26)}{chr(97 + j)}" for j in range(1 + i % 9)) + " " + "".join(chr(97 + int(c)) for c in str(i)) for i in range(2400)]
    d = docs(spark, [(i, t, "en") for i, t in enumerate(texts + texts[:300])])
    model = langid.WordBackoff({"en": {"the": 30, "abc": 9, "bcd": 5, "cab": 2}, "de": {"der": 30}})
    fits = sorted(langid.Scorer(model).fit(t, "en") for t in texts)
    mid = langid.usual_fits(d, model)["en"][0]
    assert abs(mid - (fits[1199] + fits[1200]) / 2) < 1.1e-3


def test_usual_fits_read_texts_once(spark, monkeypatch):
    """Each text's fit is made by one Python step, not by one for the filter and another for the value."""
    d, plans = docs(spark), []
    model, collect = langid.fit(d), type(d).collect
    monkeypatch.setattr(type(d), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    assert langid.usual_fits(d, model)
    assert [p.count("ArrowEvalPython") for p in plans] == [1]


def test_workers_let_go_of_other_operators():
    """A step that keeps nothing itself frees what the operator before it kept."""
    common.held(("words", 0), lambda: "large")
    common.forget()
    assert not common._held


def test_language_stage_frees_its_model(spark, monkeypatch):
    """The driver gives the memory of the model back before the later stages run."""
    made, seen, fit = [], [], langid.fit

    def kept(docs):
        model = fit(docs)
        made.append(weakref.ref(model))
        return model

    monkeypatch.setattr(langid, "fit", kept)
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda: seen.append(made[0]()), raising=False)
    assert corpus_pipeline.language(spark, docs(spark), "").columns and seen == [None]
