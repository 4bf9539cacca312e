"""Good and bad texts to a trained quality probe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.probe import TextProbe, best_probe, decide, text_features, with_logit
from ..operators.sampling import exact_sample, labelled_union, train_test_split, write_out_copies
from ..operators.scores import classification_report
from ..runtime import materialise

# Rows per class of the two recipes.
CURATED_AGAINST_CRAWL = 10_000
GOOD_AGAINST_BAD = 15_000


@dataclass(frozen=True)
class Trained:
    model: TextProbe
    reg: float
    scores: DataFrame
    report: DataFrame


def labelled_sample(
    good: DataFrame, bad: DataFrame, key: str, n: int, seed: int = 42, copies: str | None = None
) -> DataFrame:
    """``n`` seeded rows of each class (1 good, 0 bad) with their split.

    ``key`` must be unique over both inputs. Equal texts may come as one row
    with their number in ``copies``; they then stay on one side of the split.
    """
    columns = [key, "text"] + ([copies] if copies else [])
    parts = [
        exact_sample(rows.select(*columns), n, key, seed=seed, copies=copies).withColumn("label", F.lit(float(label)))
        for rows, label in ((good, 1), (bad, 0))
    ]
    sample = labelled_union(parts)
    if copies:
        sample = write_out_copies(sample, copies)
    return train_test_split(sample, key, seed=seed)


def train_quality_probe(sample: DataFrame, size: int = 1024, grid=(0.01, 0.1, 1.0), max_tokens: int | None = None) -> Trained:
    """Fit features on the training rows, probes on stored features, keep the
    best by macro F1 on the test rows. The grid has no 0 of its own accord, as
    hashed words depend on each other; with 0 the fit of smallest norm is taken."""
    stored = materialise(sample, "labelled-sample")
    train, test = stored.where(F.col("split") == "train"), stored.where(F.col("split") == "test")
    features = text_features(size=size, max_tokens=max_tokens).fit(train)
    fitted = materialise(features.transform(train).select("label", "features"), "train-features")
    held_out = materialise(features.transform(test).select("label", "features"), "test-features")
    probe, reg, scores = best_probe(fitted, held_out, grid, size)
    predictions = decide(with_logit(held_out, probe)).select(F.col("label").cast("int").alias("label"), "pred")
    return Trained(TextProbe(features, probe), reg, scores, classification_report(predictions))
