"""Mixing sources to target weights.

Words are counted per source, targets follow from the weights, and each document
is emitted ``floor(rate)`` times and once more with probability equal to the
fraction of its source's rate, drawn from a hash of its key. Only narrow rows
meet the shuffle: a partial sum per source, whatever share a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ids import numbered_keys
from ..runtime import broadcast_if_small, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``rate`` from rows of
    ``source`` and ``size``.

    Sources take the weights in turn in code point order, null last. They share
    the sum of all sizes by weight; a target stops at ``cap`` times its source's
    size and the excess is shared again among the others until none is above. A
    source without words has target 0 and rate 0; an empty table gives no rows.
    """
    sums = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    numbers = numbered_keys(sums.select(F.col("source").isNull().alias("_null"), "source"), "_number")
    numbers = numbers.select(F.col("source").alias("_source"), "_number")
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("_number") % len(weights) + 1).cast("int"))
    rows = sums.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).withColumn("weight", choice)
    rows = materialise(rows.select("source", "source_size", "weight"), "source-weights")
    first = rows.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    total, level, before = first["total"] or 0, 0.0, None
    capped, free = 0, first["weight"] or 0
    while (capped, free) != before:  # each round caps at least one more source
        before = (capped, free)
        level = (total - cap * capped) / free if free else 0.0
        full = F.col("source_size") * cap <= F.col("weight") * F.lit(level)
        row = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        capped, free = row["capped"], row["free"]
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of the seed and the key; rows with equal
    keys draw alike, a null key draws as the text ``null``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    whole = F.floor(rate)
    return whole + (draw(key, seed) < rate - whole).cast("long")


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap=CAP, seed=SEED, key="doc_id", text="text", source="source"):
    """Per row of ``docs``: the key, ``size``, ``source_size``, ``target`` and
    ``copies``, how often the mix has the document.

    A null text has size 0. Null sources are a source of their own. Rows with
    equal keys get equal draws. Other columns are not read.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_own"), word_count(F.col(f"`{text}`")).alias("size")
    )
    rows = materialise(rows, "document-sizes")
    targets = broadcast_if_small(source_targets(rows.withColumnRenamed("_own", "source"), weights, cap))
    joined = rows.join(targets, F.col("_own").eqNullSafe(F.col("source")))
    return joined.select(
        F.col("_key").alias(key), "size", "source_size", "target", copies(F.col("rate"), F.col("_key"), seed).alias("copies")
    )


def mix(docs: DataFrame, weights=WEIGHTS, cap=CAP, seed=SEED, key="doc_id", text="text", source="source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, all their columns, each as often as
    ``mix_plan`` says. Columns of ``docs`` may have any names."""
    sizes = docs.select(F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    rates = source_targets(sizes, weights, cap).select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # none of them clashes
    place = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    joined = own.join(broadcast_if_small(rates), place[source].eqNullSafe(F.col("__mix_source")))
    times = copies(F.col("__mix_rate"), place[key], seed).cast("int")
    repeated = F.explode(F.array_repeat(F.lit(True), times)).alias("__mix_copy")
    return joined.select(*place.values(), repeated).select(*[c.alias(name) for name, c in place.items()])
