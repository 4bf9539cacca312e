"""Classification metrics, all built from the confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binary_decision(output: Column, threshold: float = 0.5) -> Column:
    """1 if the raw output lies strictly above the threshold."""
    return (output > threshold).cast("int")


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """label, pred, n for the pairs that occur: the only pass over the rows."""
    return predictions.groupBy("label", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts over the full grid of classes seen as label or prediction.

    The grid has one cell per pair of classes, so it is built from the counts
    in a single row.
    """
    cells = confusion_counts(predictions).agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("label", "pred"), "n"))).alias("counts"),
        F.array_union(F.collect_set("label"), F.collect_set("pred")).alias("classes"),
    )
    grid = cells.select("counts", "classes", F.explode("classes").alias("label"))
    grid = grid.select("counts", "label", F.explode("classes").alias("pred"))
    found = F.try_element_at("counts", F.struct("label", "pred"))
    return grid.select("label", "pred", F.coalesce(found, F.lit(0)).alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def class_scores(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class (0/0 counts as 0)."""
    by = by or []
    counts = predictions.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    sides = counts.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"), F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits"),
                ),
                F.struct(
                    F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"),
                ),
            )
        ),
    )
    totals = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    return totals.select(
        *by,
        "class",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def _averages(scores: DataFrame, by: list[str]) -> DataFrame:
    def weighted(name):
        return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    return scores.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )


def classification_report(predictions: DataFrame) -> DataFrame:
    """Rows per class, then ``macro avg``, ``weighted avg`` and ``accuracy``, from
    one pass: the summary is the grand total of a rollup over the classes."""

    def weighted(name):
        return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    names = ("precision", "recall", "f1")
    levels = class_scores(predictions).rollup("class").agg(
        F.grouping("class").alias("total"),
        *[F.avg(m).alias(m) for m in names],
        *[weighted(m).alias(f"weighted_{m}") for m in names],
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def row(name, *values):
        return F.struct(name.alias("name"), *[v.alias(m) for m, v in zip(names, values, strict=True)], F.col("support").alias("support"))

    c = F.col
    summary = F.array(
        row(F.lit("macro avg"), *map(c, names)),
        row(F.lit("weighted avg"), *[c(f"weighted_{m}") for m in names]),
        row(F.lit("accuracy"), *[c("accuracy")] * 3),
    )
    one = F.array(row(c("class").cast("string"), *map(c, names)))
    # an empty input has a grand total of nothing, and averages of nothing
    return levels.select(F.inline(F.when(c("total") == 0, one).otherwise(summary)))


def macro_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro precision, recall, F1 and accuracy (per ``by`` value)."""
    by = by or []
    return _averages(class_scores(predictions, by), by).select(
        *by,
        F.col("macro_precision").alias("precision"),
        F.col("macro_recall").alias("recall"),
        F.col("macro_f1").alias("f1_macro"),
        "accuracy",
    )
