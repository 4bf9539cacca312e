"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, fingerprints, hard_negatives, jaccard_join, language_crf, mixing, pii, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TOKEN_LIMIT = 512


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def labels(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet").select(*columns)


@query
def op1_token_counts(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(documents(spark, folder, "doc_id", "text"), path, TOKEN_LIMIT)


@query
def op2_quality_trees(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    held_out = quality_classifier.remainder(F.col("doc_id"), 4) == 2
    model = quality_classifier.fit(docs, labels(spark, folder, "doc_id", "quality").where(~held_out), label="quality")
    scores = quality_classifier.scored(docs, model)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op3_super_kmers(spark, folder):
    return substring_dedup.digests(documents(spark, folder, "doc_id", "text"))


@query
def op4_content_chunks(spark, folder):
    return fingerprints.compared(documents(spark, folder, "doc_id", "text"))


@query
def op5_source_mix(spark, folder):
    plan = mixing.mix_plan(documents(spark, folder, "doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken)


@query
def op6_byte_bpe(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(documents(spark, folder, "doc_id", "text"), path, public_tokenizers.PATTERN)


@query
def op7_robust_outliers(spark, folder):
    rows = quality_rules.quality_rules(documents(spark, folder, "doc_id", "text", "lang", "source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return rows.select("doc_id", *names)


@query
def op9_weak_pii(spark, folder):
    return pii.personal_data(documents(spark, folder, "doc_id", "text"))


@query
def op8_toxic_strings(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    held_out = quality_classifier.remainder(F.col("doc_id"), 5) == 0
    machine = toxicity.fit(docs, labels(spark, folder, "doc_id", "toxic").where(~held_out), label="toxic")
    scores = toxicity.scored(docs, machine)
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op10_fragment_join(spark, folder):
    return jaccard_join.jaccard_components(documents(spark, folder, "doc_id", "text"))


@query
def op11_box_negatives(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


@query
def op12_language_chain(spark, folder):
    docs = documents(spark, folder, "doc_id", "text", "lang")
    held_out = language_crf.held_out(F.col("doc_id"))
    model = language_crf.fit(docs.where(~held_out))
    found = language_crf.predicted(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op13_conversation_repair(spark, folder):
    messages = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_report(conversation_repair.damaged(messages), every=messages)
