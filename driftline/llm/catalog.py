"""Queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from driftline.llm import ann, bpe, dartminhash, langid, licenses, linedup, packing, quality, sharding, winnow
from driftline.llm.common import table
from driftline.workers import with_workers


def op1_learned_partitions(spark, sf_dir):
    """Twenty nearest of every twentieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op2_line_dedup(spark, sf_dir):
    """Lines left of every document once later copies of runs of 50 words or more are gone."""
    told = linedup.delete_later_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.size("__deleted").alias("n_deleted"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op3_importance_resampling(spark, sf_dir):
    """Importance weight and Gumbel draw of every document."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minimax_shards(spark, sf_dir):
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op5_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_dart_minhash(spark, sf_dir):
    """Near-duplicate class of every document."""
    return dartminhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op7_winnowing(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return winnow.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    """Byte-level BPE ids of every document, as digests, and their decoding."""
    import public_tokenizers as public

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


def op9_language(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    train = docs.where(~held)
    told = langid.predict_languages(train, docs.select("doc_id", "text"))
    return told.select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op10_license_scan(spark, sf_dir):
    """Licence of every document whose entire text is one."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def queries():
    made = {
        "op1_learned_partitions": op1_learned_partitions,
        "op2_line_dedup": op2_line_dedup,
        "op3_importance_resampling": op3_importance_resampling,
        "op4_minimax_shards": op4_minimax_shards,
        "op5_packing": op5_packing,
        "op6_dart_minhash": op6_dart_minhash,
        "op7_winnowing": op7_winnowing,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_language": op9_language,
        "op10_license_scan": op10_license_scan,
        "pipeline": corpus_pipeline.run,
    }
    return {name: with_workers(f) for name, f in made.items()}


def oracle_sql():
    made = {"op2_line_dedup": linedup.oracle(), "op10_license_scan": licenses.oracle()}
    if corpus_pipeline.ORACLE_SQL:
        made["pipeline"] = corpus_pipeline.ORACLE_SQL
    return made
