"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again.

Language ID, quality classifier, line dedup, near-duplicate removal, packing. All stages but the last
return the columns of ``documents``. SQL cannot express the learned stages, so ``ORACLE_SQL`` is None
and tests/llm holds each stage against a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import dartminhash, langid, linedup, packing, quality
from driftline.llm.common import cut, give_back, remove, shared_dir
from driftline.workers import with_workers

#: Below so many times the share that each language would have if all fitted alike, a text is in none.
LEAST_LANGUAGE_SHARE = 1.4


@with_workers
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or are in none of the languages: by the share of the
    best language, and by how far the text's trigrams are from labelled texts of that language."""
    model = langid.fit(docs)
    judge = langid.judge(spark, model, langid.usual_fits(docs, model))
    told = docs.withColumn("__p", judge(F.col("text")))
    least = LEAST_LANGUAGE_SHARE / max(1, len(model.langs)) if len(model.langs) > 1 else 0.0
    del model  # workers have their copy; the driver needs its memory for the later stages
    give_back()
    return told.where((F.col("__p.lang") != langid.UNDETERMINED) & (F.col("__p.score") >= least) & F.col("__p.fits")).select(*docs.columns)


@with_workers
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose importance weight lies on the bad side of the labelled cut."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.weigh(docs, model).where("__accepted").select(*docs.columns)


@with_workers
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document without a word left goes."""
    told = linedup.delete_later_copies(docs).where(F.col("text").rlike(r"\S"))
    return told.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@with_workers
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; null and empty texts are no duplicates."""
    return dartminhash.one_of_each(docs)


@with_workers
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and the sequences they are packed into; a null or empty text is the end
    token alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good_quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The stages' files are in the shared folder and go once the last
    stage has cut its lineage from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    packed = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, base)
    return packed
