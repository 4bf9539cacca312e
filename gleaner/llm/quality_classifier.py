"""Quality classifier: histogram gradient-boosted trees over text statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE``), features
cut into at most ``BINS`` classes so that a split is found from histograms. A
fitted model is a few flat arrays: trees are complete binary trees, and all rows
of a batch walk down all trees by array indexing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import COUNTS, counts
from .words import slices

SAMPLE = 20_000  # labelled rows that a model is fitted on, at most
BINS, DEPTH, TREES, RATE = 48, 4, 80, 0.15
MIN_HESSIAN, RIDGE = 2.0, 1.0
THRESHOLD = 0.7
FEATURES = (
    "words", "word_length", "length_spread", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "pipes",
    "distinct", "stutter", "odd_ends", "words_a_line", "stops", "commas", "wide", "longest", "short_words", "capitals",
)


def features(column: pa.Array) -> np.ndarray:
    """The statistics of each text, by the order of ``FEATURES``; an empty or
    null text gives zeros."""
    c = {name: value.astype(float) for name, value in counts(column).items()}
    assert set(c) == set(COUNTS)
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    letters, rows = np.maximum(c["upper"] + c["lower"], 1), np.maximum(c["n_lines"], 1)
    mean = c["word_chars"] / n
    columns = [
        np.log1p(c["n_words"]), mean, np.sqrt(np.maximum(c["squares"] / n - mean**2, 0)), c["n_symbols"] / n,
        c["n_dup_lines"] / rows, c["n_repeat_words"] / n, c["upper"] / letters, c["digits"] / chars, c["bangs"] / n,
        c["pipes"] / n, c["distinct"] / n, c["stutter"] / n, c["odd_ends"] / n, np.log1p(c["n_words"] / rows),
        c["stops"] / n, c["commas"] / n, c["wide"] / chars, np.log1p(c["longest"]), c["short_words"] / n, c["capitals"] / n,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """``TREES`` complete trees of ``DEPTH`` levels: ``feature`` and ``cut`` of
    the inner nodes, ``leaf`` values; node ``i`` has the children ``2i + 1`` and
    ``2i + 2``. ``base`` is the log-odds of the sample."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the log loss. Without rows, or with one label only,
    the model is the constant smoothed share of label 1."""
    base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    total, parts = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, size = 2**level - 1, 2**level
            best_gain, best = np.zeros(size), np.full((size, 2), -1)
            for f, edge in enumerate(edges):
                cell = (node - first) * BINS + binned[:, f]
                g = np.bincount(cell, gradient, size * BINS).reshape(size, BINS)
                h = np.bincount(cell, hessian, size * BINS).reshape(size, BINS)
                left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = (
                    left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
                )
                gain[(left_h < MIN_HESSIAN) | (all_h - left_h < MIN_HESSIAN)] = 0
                gain[:, len(edge) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(size), at]
                better = top > best_gain + 1e-9
                best_gain[better], best[better] = top[better], np.stack([np.full(size, f), at], 1)[better]
            for i in range(size):
                if best[i, 0] >= 0:
                    feature[first + i], cut[first + i] = best[i, 0], edges[best[i, 0]][best[i, 1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        place = node - inner
        leaf = RATE * np.bincount(place, gradient, leaves) / (np.bincount(place, hessian, leaves) + RIDGE)
        total += leaf[place]
        parts.append((feature, cut, leaf))
    return Trees(base, *map(np.stack, zip(*parts, strict=True)))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string")) % by


def bounded_sample(labels: DataFrame, label: str, key: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled rows, by the order of a hash of the key."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    return rows.orderBy(F.xxhash64("_key"), "_key", "_label").limit(limit)


def training_rows(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="quality", limit=SAMPLE):
    """Features and labels of the documents in the sample; the sample's keys are
    bounded by ``limit`` and broadcast, so texts are not shuffled."""
    sample = F.broadcast(bounded_sample(labels, label, key, limit))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(sample, "_key").select("_text", "_label")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(features(part.column(0)).tolist(), pa.list_(pa.float64())), part.column(1).cast(pa.int32())], ["x", "y"]
                )

    found = rows.mapInArrow(run, "x array<double>, y int").orderBy("y", "x").toPandas()
    return np.array(found["x"].tolist()).reshape(len(found), len(FEATURES)), found["y"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Trees:
    return fit_trees(*training_rows(docs, labels, **columns))


def scored(docs: DataFrame, model: Trees, key="doc_id", text="text", threshold=THRESHOLD) -> DataFrame:
    """Per row of ``docs``: the key, ``score`` (probability of label 1) and
    ``predicted``. A null or empty text is scored as one without words. Null and
    repeated keys are passed on row by row; other columns are not read."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                score = model.score(features(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["_key", "score", "predicted"]
                )

    return rows.mapInArrow(run, f"_key {kind}, score double, predicted int").withColumnRenamed("_key", key)
