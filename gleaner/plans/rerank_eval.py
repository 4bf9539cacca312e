"""Retrieval evaluation over a grid of quality weights and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators.retrieval import dense_topk, ranking_metrics, sweep
from ..runtime import materialise

# The weights of the evaluation grid.
QUALITY_WEIGHTS = [0.96, 0.97, 0.98, 0.99]


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 50, **options) -> DataFrame:
    """The baseline run, stored once for all settings."""
    return materialise(dense_topk(queries, corpus, k, **options), "top-k")


def evaluate(
    judged_run: DataFrame,
    qualities: dict[str, Column],
    weights: list[float] | None = None,
    k: int = 10,
    mode: str = "minmax",
) -> DataFrame:
    """Metrics per model, weight and task. ``judged_run`` holds query_id,
    doc_id, sim, task, rel, n_relevant and whatever ``qualities`` refer to."""
    ranked = sweep(judged_run, qualities, weights or QUALITY_WEIGHTS, mode)
    return ranking_metrics(ranked, k, ("model", "quality_p", "task"))
