"""Corpus-trained n-gram language models and per-document perplexity."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from ..runtime import BROADCAST_BYTES, computed, materialise
from .lookup import lookup_sums
from .packing import BUCKET_TEXT, counted

START = "<s>"


@dataclass(frozen=True)
class NgramModel:
    """``weights``: key, n, w, where a document's log-likelihood is the sum of w
    over its keys plus ``base`` per token."""

    order: int
    weights: DataFrame
    base: float


def _words(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word."""
    return docs.select(*keep, F.explode(txt.words(F.col(text))).alias("key"))


def _pairs(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word with the word ``before`` it (the first follows the
    start mark) and the two as ``key``."""
    listed = computed(docs.select(*keep, text), "_words", txt.words(F.col(text)))
    before = F.slice(F.concat(F.array(F.lit(START)), F.col("_words")), F.lit(1), F.size("_words"))
    zipped = listed.select(*keep, F.inline(F.arrays_zip(before.alias("before"), F.col("_words").alias("word"))))
    return zipped.select(*keep, "before", F.concat("before", F.lit(" "), "word").alias("key"))


def _count(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def fit_unigrams(docs: DataFrame, text: str = "text") -> NgramModel:
    """p(t) = (n(t) + 1) / (N + V); only seen tokens carry a weight."""
    counts = materialise(_count(_words(docs, text)), "unigrams")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    weights = counts.select("key", "n", F.ln(F.col("n") + 1.0).alias("w"))
    return NgramModel(1, weights, -math.log(max(size["n"] + size["v"], 1)))


def fit_bigrams(docs: DataFrame, text: str = "text") -> NgramModel:
    """p(t|u) = (n(u,t) + 1) / (n(u) + V), the first token after a start mark.

    ln p splits into ln(n(u,t) + 1), zero for unseen pairs, and
    -ln(1 + n(u)/V) - ln V, constant for unseen contexts. Pairs and contexts
    share one weight table, which each occurrence looks up by both keys.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_TEXT))
    pairs = materialise(counted(_pairs(docs, text).select("key"), buckets), "bigrams")
    roles = pairs.select(
        F.inline(
            F.array(
                F.struct(F.substring_index("key", " ", 1).alias("key"), F.col("n").alias("n"), F.lit(False).alias("_word")),
                F.struct(F.substring_index("key", " ", -1).alias("key"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("_word")),
            )
        )
    )
    words = materialise(roles.groupBy("key").agg(F.sum("n").alias("n"), F.bool_or("_word").alias("_word")), "contexts")
    vocabulary = max(words.agg(F.count_if("_word").alias("v")).first()["v"], 1)
    contexts = words.where(F.col("n") > 0).select(
        "key", "n", (-F.log1p(F.col("n") / F.lit(float(vocabulary)))).alias("w")
    )
    weights = pairs.select("key", "n", F.ln(F.col("n") + 1.0).alias("w")).unionByName(contexts)
    return NgramModel(2, weights, -math.log(vocabulary))


def perplexity(
    docs: DataFrame, model: NgramModel, row_id: str = "doc_id", text: str = "text", budget: int = BROADCAST_BYTES
) -> DataFrame:
    """``row_id``, n_tokens, mean negative log-likelihood, its exponential and
    the quality 1 / (1 + perplexity). Rows without tokens are absent."""
    if model.order == 1:
        sums = lookup_sums(_words(docs, text, row_id), row_id, model.weights, budget)
    else:
        sums = lookup_sums(_pairs(docs, text, row_id), row_id, model.weights, budget, ("before", "key"))
    scored = sums.select(row_id, F.col("n").alias("n_tokens"), (-F.col("w") / F.col("n") - model.base).alias("nll"))
    return scored.withColumn("perplexity", F.exp("nll")).withColumn("quality", 1.0 / (1.0 + F.col("perplexity")))
