"""Mean pooling of token vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_pool(vectors: DataFrame, by: str, vector: str, mask: Column | None = None) -> DataFrame:
    """Mean vector per ``by`` value; every row counts unless ``mask`` drops it.

    One vector buffer per group and task is merged, so neither wide vectors nor
    a hot group multiply the rows that are shuffled.
    """
    kept = vectors if mask is None else vectors.where(mask)
    wide = kept.select(by, array_to_vector(F.col(vector).cast("array<double>")).alias("_vector"))
    pooled = wide.groupBy(by).agg(Summarizer.mean(F.col("_vector")).alias("_mean"), F.count("*").alias("n"))
    return pooled.select(by, vector_to_array("_mean").alias("embedding"), "n")
