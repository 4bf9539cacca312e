"""The corpus pipeline over ``documents``: bad texts go, one document of each group
of near copies stays, personal data is masked, sources are mixed to their
weights, and what is left is encoded.

Each stage works on all rows its predecessor kept. ``run`` writes each stage's
rows as Parquet to the shared scratch folder and reads them again, so a lost
executor costs the present stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, jaccard_join, mixing, pii, quality_rules
from gleaner.runtime import materialise

NEAR_WORDS, NEAR_PERCENT = 5, 80  # of near copies; op10 has numbers of its own


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies: texts
    whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, n=NEAR_WORDS, percent=NEAR_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; ``n_chars`` follows the text."""
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target of their source wants them, or not at all."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the digests of ids and decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

# Estimates, tie breaking by hashes and the tokenizer are beyond SQL; the tests
# compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
