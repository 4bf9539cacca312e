"""Scores over a row's logits or class probabilities (``ARRAY<DOUBLE>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so no exponent overflows."""
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(_total(p), lambda t: F.transform(p, lambda e: e / t)))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest entry; ties go to the lowest."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def label_of(index: Column, labels: dict[int, str]) -> Column:
    pairs = [F.lit(part) for pair in sorted(labels.items()) for part in pair]
    return F.element_at(F.create_map(*pairs), index)


def topk_mean(values: Column, k: int = 3) -> Column:
    """Mean of the ``k`` largest entries."""
    return let(
        F.slice(F.sort_array(values, asc=False), 1, k), lambda top: _total(top) / F.size(top)
    )


def max_or_default(values: Column, threshold: float = 0.5, default: float = 0.2) -> Column:
    """Largest entry if strictly above ``threshold``, else ``default``."""
    best = F.array_max(values)
    return F.when(best > threshold, best).otherwise(F.lit(default))


def entropy(values: Column, epsilon: float = 1e-12) -> Column:
    return -_total(F.transform(values, lambda p: p * F.ln(p + epsilon)))


def entropy_confidence(values: Column) -> Column:
    """(1 - entropy / ln(classes)) times the largest probability.

    A single class has no uncertainty: its confidence is its probability.
    """
    classes = F.size(values)
    normalised = F.when(classes > 1, entropy(values) / F.ln(classes.cast("double"))).otherwise(0.0)
    return (1.0 - normalised) * F.array_max(values)
