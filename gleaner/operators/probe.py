"""Text features, linear quality probe and domain classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions.hashing import bucket_counts
from ..functions.probability import sigmoid
from ..runtime import materialise
from . import ridge
from .scores import binary_decision, macro_metrics

ITERATIONS = 500  # of the multinomial solver; a fit that needs more fails
TEXT_PENALTY = 0.01  # hashed words depend on each other
CLASS_BYTES = 8 << 20  # of class vectors that a task holds at a time


@dataclass(frozen=True)
class HashedWords:
    """Word counts by bucket; whole texts, or the first ``max_tokens`` words as an
    encoder with a length limit would read."""

    size: int = 1024
    max_tokens: int | None = None
    text: str = "text"

    def counts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features``: places and counts of the buckets that occur."""
        words = txt.words(F.col(self.text))
        return rows.withColumn("features", bucket_counts(words if self.max_tokens is None else F.slice(words, 1, self.max_tokens), self.size))

    def fit(self, rows: DataFrame) -> WordFeatures:
        """Inverse document frequencies, ln((rows + 1) / (rows with the bucket + 1))."""
        at = F.explode(F.array_append("features.at", F.lit(-1))).alias("at")  # -1 counts the rows
        found = {r["at"]: r["count"] for r in self.counts(rows).select(at).groupBy("at").count().collect()}
        total = found.get(-1, 0)
        return WordFeatures(self, tuple(float(np.log((total + 1) / (found.get(i, 0) + 1))) for i in range(self.size)))


@dataclass(frozen=True)
class WordFeatures:
    """Counts weighted by inverse document frequency."""

    words: HashedWords
    weights: tuple[float, ...]

    def transform(self, rows: DataFrame) -> DataFrame:
        weights = F.lit(list(self.weights))
        counted = F.col("features")
        x = F.zip_with(counted["at"], counted["x"], lambda at, n: n * F.get(weights, at))
        return self.words.counts(rows).withColumn("features", F.struct(counted["at"].alias("at"), x.alias("x")))


@dataclass(frozen=True)
class TextProbe:
    """Features and probe as one model that can be saved and loaded."""

    features: WordFeatures
    probe: ridge.Probe

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features`` and ``logit``."""
        return self.features.transform(rows).withColumn("logit", self.probe.output(sparse=True))


def text_features(size: int = 1024, max_tokens: int | None = None, text: str = "text") -> HashedWords:
    return HashedWords(size, max_tokens, text)


def vector_features(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Given (frozen) encoder vectors as the feature column."""
    return rows.withColumn("features", F.col(vector).cast("array<double>"))


def _size(rows: DataFrame) -> int:
    found = rows.select(F.max(F.size("features")).alias("n")).first()["n"]
    return found or 0


def probe_grid(train: DataFrame, penalties: Sequence[float], size: int | None = None) -> list[ridge.Probe]:
    """A probe for each penalty from one pass over ``features`` and ``label``."""
    return ridge.fits(ridge.products(train, _size(train) if size is None else size), penalties)


def linear_probe(train: DataFrame, penalty: float = 0.0, size: int | None = None) -> ridge.Probe:
    """One linear output under squared loss on frozen features."""
    return probe_grid(train, [penalty], size)[0]


def with_logit(rows: DataFrame, probe: ridge.Probe) -> DataFrame:
    return rows.withColumn("logit", probe.output(sparse=ridge.is_sparse(rows, "features")))


def decide(scored: DataFrame) -> DataFrame:
    """Training-time decision: raw output strictly above 0.5. Scoring applies a
    sigmoid instead; the two thresholds differ on purpose."""
    return scored.withColumn("pred", binary_decision(F.col("logit")))


def best_probe(train: DataFrame, held_out: DataFrame, grid=(0.0, 0.01, 0.1), size: int | None = None):
    """The probe with the best macro F1 on the held-out rows, its penalty, and the
    scores of all. One pass fits the grid, another scores it; ties go to the
    smaller penalty."""
    probes = probe_grid(train, sorted(grid), size)
    sparse = ridge.is_sparse(held_out, "features")
    outputs = F.array(*[F.struct(F.lit(p.penalty).alias("reg"), p.output(sparse=sparse).alias("logit")) for p in probes])
    stacked = held_out.select(F.col("label").cast("int").alias("label"), F.inline(outputs))
    scores = macro_metrics(decide(stacked), ["reg"])
    rows = scores.collect()  # one row per grid value
    best = min(rows, key=lambda r: (-r["f1_macro"], r["reg"]))["reg"]
    return next(p for p in probes if p.penalty == best), best, scores


def score_corpus(rows: DataFrame, model: TextProbe | ridge.Probe) -> DataFrame:
    """Quality score of every row: sigmoid of the probe's output. A text without
    words has the probe's constant."""
    scored = model.transform(rows) if isinstance(model, TextProbe) else with_logit(rows, model)
    return scored.withColumn("score", sigmoid(F.col("logit")))


def text_probe(train: DataFrame, size: int = 1024, penalty: float = TEXT_PENALTY, text: str = "text", max_tokens: int | None = None) -> TextProbe:
    features = text_features(size, max_tokens, text).fit(train)
    return TextProbe(features, linear_probe(features.transform(train), penalty, size))


_SAVED = "size INT, max_tokens INT, text STRING, weights ARRAY<DOUBLE>, penalty DOUBLE, coefficients ARRAY<DOUBLE>, intercept DOUBLE"


def save_model(spark: SparkSession, model: TextProbe, path: str) -> None:
    own, probe = model.features, model.probe
    row = (own.words.size, own.words.max_tokens, own.words.text, list(own.weights), probe.penalty, [float(w) for w in probe.coefficients], probe.intercept)
    spark.createDataFrame([row], _SAVED).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> TextProbe:
    row = spark.read.schema(_SAVED).parquet(path).first()
    words = HashedWords(row["size"], row["max_tokens"], row["text"])
    return TextProbe(WordFeatures(words, tuple(row["weights"])), ridge.Probe(row["penalty"], np.array(row["coefficients"]), row["intercept"]))


def domain_model(train: DataFrame, label: str = "domain", max_iter: int = ITERATIONS, reg: float = 0.0):
    """Multinomial classifier over ``features`` (arrays); ``label`` is a class number."""
    model = LogisticRegression(
        featuresCol="_vector", labelCol=label, family="multinomial", maxIter=max_iter, regParam=reg,
        probabilityCol="probabilities", predictionCol="class",
    ).fit(train.withColumn("_vector", array_to_vector("features")))
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"no convergence within {max_iter} iterations; use a penalty")
    return model


def domains(rows: DataFrame, model) -> DataFrame:
    return model.transform(rows.withColumn("_vector", array_to_vector("features"))).drop("_vector")


def centroid_domains(rows: DataFrame, centroids: DataFrame, row_id: str = "vec_id", vector: str = "embedding", block_bytes: int = CLASS_BYTES) -> DataFrame:
    """``row_id``, ``domain`` and ``p``: the class whose centroid is most similar
    (ties: the first by name) and its share of the softmax over all classes.

    ``centroids`` (label, embedding) has one row per class, any number of them: they
    are dealt into blocks of ``block_bytes``, numbered by a stored sort, and each
    block is multiplied with the rows as they stream by. A block gives a row its
    largest similarity, whose class it is and the sum of exponentials relative to
    it; the blocks' numbers are merged like that of one softmax.
    """
    named = centroids.select(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    stored = materialise(named.where("label IS NOT NULL"), "centroids")
    total = stored.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-total["n"] * total["d"] * 8 // block_bytes))
    kind = rows.schema[row_id].dataType.simpleString()
    shape = f"id {kind}, top double, domain string, mass double"
    points = rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for block in range(blocks):
        held = stored.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == block).orderBy("label").toArrow()  # a bounded share of the classes
        if not held.num_rows:
            continue
        names = np.array(held.column("label").to_pylist(), object)
        matrix = np.array(held.column("embedding").to_pylist(), float)

        def run(batches, names=names, matrix=matrix):
            for batch in batches:
                step = max(1, (4 << 20) // max(1, len(names)))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    x = np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1)
                    sims = x @ matrix.T
                    best = sims.argmax(1)
                    top = sims[np.arange(len(sims)), best]
                    mass = np.exp(sims - top[:, None]).sum(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(top), pa.array(names[best], pa.string()), pa.array(mass)], ["id", "top", "domain", "mass"])

        part = points.mapInArrow(run, shape)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.limit(0).select(row_id, F.lit("").alias("domain"), F.lit(0.0).alias("p"))
    if blocks > 1:
        order = F.struct(-F.col("top"), F.col("domain"))
        best = found.groupBy("id").agg(F.min(order).alias("b"), F.collect_list(F.struct("top", "mass")).alias("parts"))
        mass = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["mass"] * F.exp(x["top"] + F.col("b.col1")))
        found = best.select("id", F.col("b.domain").alias("domain"), mass.alias("mass"))
    return found.select(F.col("id").alias(row_id), "domain", (1 / F.col("mass")).alias("p"))
