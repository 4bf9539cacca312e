"""Quality rules: hard limits, then robust multivariate outliers.

Each text gives a vector of transformed statistics. For each language and source
the minimum covariance determinant estimate of centre and scatter is found by
concentration steps: distances under the present estimate, the nearest
``SHARE`` of the rows, their mean and covariance. A step is one aggregation of
moments by group and distance class, so a group of any size is summed up map-side
and no group is ever gathered. Rows beyond a Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import broadcast_if_small, materialise
from .textstats import BASE, counts
from .words import slices, thrifty

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SHARE = 0.75  # of a group's rows that an estimate rests on
STEPS = 6
MIN_ROWS = 100  # smaller groups use the estimate of their language, or of all
TAIL = 1e-9  # share of a normal population beyond the cut
# Smallest standard deviation of each statistic. Most clean texts have none of a
# defect at all; without it the first symbol would be infinitely far away.
# A floor also bounds what its statistic can add to a distance, (range / floor)^2:
# repeated lines and neighbours alone go beyond the cut. Repeated windows cannot, as
# clean texts have them up to the base limit, which rejects the others.
FLOORS = {"length": 0.08, "symbols": 0.06, "lines": 0.1, "repeats": 0.2, "upper": 0.05}
ALL_FLOORS = FLOORS | {"neighbours": 0.07}
VECTOR = tuple(ALL_FLOORS)


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


_PAIRS = _pairs(len(FLOORS))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_stats``: the base counts and the vector. A null
    text has no words; the vector of a text without words is zero."""
    stats_type = T.StructType([T.StructField(n, T.LongType()) for n in BASE] + [T.StructField(n, T.DoubleType()) for n in VECTOR])
    schema = T.StructType([*docs.schema.fields, T.StructField("_stats", stats_type)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(part.schema.get_field_index(text))
                c = counts(column, full=False)
                n = np.maximum(c["n_words"], 1)
                letters = np.maximum(c["upper"] + c["lower"], 1)
                vector = {
                    "length": np.log(np.maximum(c["word_chars"], 1) / n),
                    "symbols": np.sqrt(c["n_symbols"] / n),
                    "lines": np.sqrt(c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
                    "repeats": np.sqrt(c["n_repeat_words"] / n),
                    "upper": np.sqrt(c["upper"] / letters),
                    "neighbours": np.sqrt(c["stutter"] / n),
                }
                arrays = [pa.array(c[k], pa.int64()) for k in BASE] + [pa.array(vector[k], pa.float64()) for k in VECTOR]
                stats = pa.StructArray.from_arrays(arrays, [*BASE, *VECTOR])
                yield pa.RecordBatch.from_arrays([*part.columns, stats], [*part.schema.names, "_stats"])

    return docs.mapInArrow(thrifty(run), schema)


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _groups(lang: Column, source: Column) -> list[Column]:
    """Keys of a row's own group, its language, and all rows."""
    keep = {"ignoreNullFields": "false"}
    return [
        F.to_json(F.struct(lang.alias("lang"), source.alias("source")), keep),
        F.to_json(F.struct(lang.alias("lang")), keep),
        F.lit("{}"),
    ]


def _quantile(p: float, size: int = len(VECTOR)) -> float:
    """Of the chi-square distribution with as many degrees of freedom as the
    vector has entries (Wilson-Hilferty; ``TAIL`` is far out, where the
    approximation is good to a few percent)."""
    from statistics import NormalDist

    k = 2 / (9 * size)
    return size * (1 - k + NormalDist().inv_cdf(p) * math.sqrt(k)) ** 3


def _distance(size: int = len(VECTOR)) -> Column:
    """Squared Mahalanobis distance of ``x`` under ``centre`` and ``inverse``."""
    total = F.lit(0.0)
    for n, (i, j) in enumerate(_pairs(size)):
        left, right = (F.col("x")[k] - F.col("centre")[k] for k in (i, j))
        total = total + F.col("inverse")[n] * left * right * (1.0 if i == j else 2.0)
    return total


def _class(distance: Column) -> Column:
    """Distances in classes, 16 to a doubling."""
    return F.floor(16 * F.log2(1 + 64 * F.greatest(distance, F.lit(0.0)))).cast("int")


def _start(rows: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Medians and median absolute deviations, from counts on a grid."""
    cells = rows.select("grp", F.posexplode(F.transform("x", lambda v: F.round(v * 256).cast("int"))).alias("dim", "cell"))
    cells = materialise(cells.groupBy("grp", "dim", "cell").agg(F.count("*").alias("n")), "mcd-grid")

    def median(table: DataFrame, value: str) -> DataFrame:
        order = Window.partitionBy("grp", "dim").orderBy(value)
        whole = Window.partitionBy("grp", "dim")
        ranked = table.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(whole))
        return ranked.where("2 * upto >= all").groupBy("grp", "dim").agg(F.min(value).alias("middle"))

    centre = median(cells, "cell")
    away = cells.join(centre, ["grp", "dim"]).withColumn("away", F.abs(F.col("cell") - F.col("middle")))
    spread = median(away.drop("middle"), "away").withColumnRenamed("middle", "spread")
    both = centre.join(spread, ["grp", "dim"])
    least = F.array(*[F.lit(v) for v in floors.values()])
    deviation = F.greatest(F.col("spread") * 1.4826 / 256, F.element_at(least, F.col("dim") + 1))
    per_group = both.groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct("dim", (F.col("middle") / 256).alias("m"), (1 / deviation**2).alias("v")))).alias("e")
    )
    inverse = F.array(*[F.col("e")[i]["v"] if i == j else F.lit(0.0) for i, j in _pairs(len(floors))])
    return per_group.select("grp", F.transform("e", lambda e: e["m"]).alias("centre"), inverse.alias("inverse"), F.lit(1.0).alias("scale"))


def _estimate(sums: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Centre and inverse scatter from moments; singular scatter cannot occur,
    as the squared floors are added to the variances."""
    size, pairs = len(floors), _pairs(len(floors))
    least = np.diag(np.square(list(floors.values())))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            s = np.array(batch.column("s").to_pylist(), float).reshape(-1, size)
            q = np.array(batch.column("q").to_pylist(), float).reshape(-1, len(pairs))
            centre = s / n[:, None]
            scatter = np.zeros((len(n), size, size))
            for k, (i, j) in enumerate(pairs):
                scatter[:, i, j] = scatter[:, j, i] = q[:, k] / n - centre[:, i] * centre[:, j]
            inverse = np.linalg.inv(scatter + least)
            flat = np.stack([inverse[:, i, j] for i, j in pairs], axis=1)
            # sums come in any order; rounding makes reruns agree
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grp"),
                    pa.array(np.round(centre, 9).tolist(), pa.list_(pa.float64())),
                    pa.array(np.round(flat, 6).tolist(), pa.list_(pa.float64())),
                    batch.column("scale"),
                ],
                ["grp", "centre", "inverse", "scale"],
            )

    return sums.mapInArrow(thrifty(run), "grp string, centre array<double>, inverse array<double>, scale double")


def _step(rows: DataFrame, model: DataFrame, share: float, floors: dict[str, float]) -> DataFrame:
    size, pairs = len(floors), _pairs(len(floors))
    near = rows.join(broadcast_if_small_model(model), "grp").withColumn("d", _class(_distance(size)))
    moments = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size)]
    moments += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs]
    classes = near.groupBy("grp", "d").agg(F.count("*").alias("n"), *moments)
    before = Window.partitionBy("grp").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    ranked = classes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ranked.withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
    middle = F.min(F.when(2 * (F.col("before") + F.col("n")) >= F.col("all"), F.col("d")))
    inside = F.col("before") < F.col("all") * share
    total = lambda name: F.sum(F.when(inside, F.col(name)))
    sums = ranked.groupBy("grp").agg(
        total("n").alias("n"),
        F.array(*[total(f"s{i}") for i in range(size)]).alias("s"),
        F.array(*[total(f"q{i}_{j}") for i, j in pairs]).alias("q"),
        # the scatter of the nearest rows is too small for all rows: scaled so that the median distance is that of a normal population
        F.greatest(F.lit(1.0), (F.pow(2.0, (middle + 1) / 16) - 1) / 64 / _quantile(0.5, size)).alias("scale"),
    )
    return _estimate(sums, floors)


def broadcast_if_small_model(model: DataFrame) -> DataFrame:
    """The models are arrays, whose size is their number of rows."""
    return F.broadcast(model) if model.count() <= 200_000 else model


def fit(vectors: DataFrame, share: float = SHARE, steps: int = STEPS, min_rows: int = MIN_ROWS, floors: dict[str, float] = FLOORS) -> DataFrame:
    """Estimates from rows of ``lang``, ``source`` and ``x``, whose entries are
    the statistics of ``floors``.

    Returns ``lang``, ``source``, ``grp`` (the group whose estimate holds),
    ``centre``, ``inverse`` and ``scale``, one row per language and source.
    """
    own, language, everything = _groups(F.col("lang"), F.col("source"))
    sizes = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    languages = sizes.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("in_lang"))
    sizes = sizes.join(languages, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    chosen = F.when(F.col("n") >= min_rows, own).when(F.col("in_lang") >= min_rows, language).otherwise(everything)
    chosen = materialise(sizes.select("lang", "source", chosen.alias("grp")), "mcd-groups")
    needed = broadcast_if_small(chosen.select("grp").distinct())
    rows = vectors.select(F.explode(F.array(own, language, everything)).alias("grp"), "x")
    rows = materialise(rows.join(needed, "grp", "left_semi"), "mcd-rows")
    model = materialise(_start(rows, floors), "mcd-start")
    for _ in range(steps):
        model = materialise(_step(rows, model, share, floors), "mcd-step")
    return chosen.join(model, "grp")


def judge(stats: DataFrame, model: DataFrame) -> DataFrame:
    """Rows with ``lang``, ``source`` and ``_stats`` get ``base_failed``, ``distance``
    and ``kept``. A row whose group has no estimate has no distance and is kept
    unless it fails the base limits."""
    known = model.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "centre", "inverse", "scale")
    joined = stats.join(
        broadcast_if_small_model(known), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    joined = joined.withColumn("x", F.array(*[F.col(f"_stats.{n}") for n in VECTOR]))
    failed = base_failed(F.col("_stats.n_words"), F.col("_stats.n_repeat_words"))
    joined = joined.withColumn("base_failed", failed).withColumn("distance", _distance() / F.col("scale"))
    far = F.coalesce(F.col("distance") > _quantile(1 - TAIL), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~far).drop("_lang", "_source", "centre", "inverse", "scale", "x")


def _vectors(stats: DataFrame) -> DataFrame:
    good = ~base_failed(F.col("_stats.n_words"), F.col("_stats.n_repeat_words"))
    return stats.where(good).select("lang", "source", F.array(*[F.col(f"_stats.{n}") for n in VECTOR]).alias("x"))


def quality_rules(docs: DataFrame, key="doc_id", text="text", lang="lang", source="source") -> DataFrame:
    """Per row of ``docs``: the key, the base counts, ``base_failed``, ``distance``
    and ``kept``.

    A null or empty text has no words and fails. Null languages and sources are
    groups of their own. Repeated rows count as often as they occur. An empty
    table gives no rows. Other columns are not read.
    """
    names = {key: "_key", text: "_text", lang: "lang", source: "source"}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    stats = materialise(statistics(rows, "_text").drop("_text"), "text-statistics")
    judged = judge(stats, fit(_vectors(stats), floors=ALL_FLOORS))
    return judged.select(F.col("_key").alias(key), *[F.col(f"_stats.{n}") for n in BASE], "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text="text", lang="lang", source="source") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep. The statistics are
    computed once for the estimates and again, in place, for the verdict: texts
    are never shuffled."""
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"))
    whole = f"c{docs.columns.index(text)}"
    narrow = materialise(statistics(rows.select(whole, "lang", "source"), whole).drop(whole), "text-statistics")
    judged = judge(statistics(rows, whole), fit(_vectors(narrow), floors=ALL_FLOORS))
    return judged.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
