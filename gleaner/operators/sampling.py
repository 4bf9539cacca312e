"""Seeded, exact and partition-independent samples, shuffles and splits.

The order of a seed is ``md5(seed:key)``. It depends on the key alone, so every
result is the same for any partitioning and can be recomputed elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise
from .ids import numbered_keys
from .membership import anti_join

# Up to here a heap of keys per task is cheaper than numbering all keys.
HEAP_ROWS = 1_000
# Hex digits of the md5 order: coarse slices, then fine ones inside the slice
# that holds the cut, if that slice has more than FINE_ROWS rows.
_COARSE, _FINE, FINE_ROWS = 3, 8, 50_000
COPY_BLOCK = 10_000


def seeded_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def _attach(marked: DataFrame, cuts: DataFrame, by: str | None) -> DataFrame:
    """Add the ``_cut`` and ``_before`` of each row's class, NULL without a cut.

    There is one cut per class; without classes it is a pair of literals.
    """
    if by is None:
        row = cuts.first()
        cut, before = (row["_cut"], row["_before"]) if row else (None, None)
        return marked.withColumns({"_cut": F.lit(cut).cast("string"), "_before": F.lit(before).cast("long")})
    cuts = cuts.select(F.col("_class").alias("_cut_class"), "_cut", "_before")
    same = F.col("_class").eqNullSafe(F.col("_cut_class"))
    return marked.join(broadcast_if_small(cuts), same, "left").drop("_cut_class")


def _find_cuts(marked: DataFrame, quota: int, digits: int) -> DataFrame:
    """Per class the slice in which row number ``quota`` falls, the rows before
    it and in it. ``_base`` rows of the class lie before those of ``marked``."""
    sizes = marked.groupBy("_class", "_base", F.left("_order", F.lit(digits)).alias("_cut")).agg(
        F.sum("_weight").alias("_rows")
    )
    upto = Window.partitionBy("_class").orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sizes.withColumn("_before", F.col("_base") + F.sum("_rows").over(upto) - F.col("_rows"))
    cut = running.where((F.col("_before") < quota) & (F.col("_before") + F.col("_rows") >= quota))
    return materialise(cut.select("_class", "_cut", "_before", "_rows"), "sample-cuts")


def exact_sample(
    rows: DataFrame,
    n: int,
    key: str,
    by: str | None = None,
    seed: int = 42,
    copies: str | None = None,
    merge: bool = False,
) -> DataFrame:
    """The first ``n`` rows in seeded order of a unique ``key`` (per ``by`` value).

    With ``copies`` a row stands for that many equal rows; the column then
    returns how many of them are taken. With ``merge`` the input has no such
    column but may hold equal rows: those that can be sampled are merged into
    one row and its ``copies``, map-side first, so a hot row does no harm.

    The first passes read key columns only and count rows per slice of the hash
    order until the slice with the n-th row is small. The last pass keeps all
    rows of earlier slices and ranks only inside slices, so no task sorts a
    whole class however large ``n`` or the class is, and only sampled rows are
    shuffled.
    """
    if n <= 0:
        none = rows.where(F.lit(False))
        return none.withColumn(copies, F.lit(0).cast("long")) if merge else none
    weight = F.col(copies).cast("long") if copies and not merge else F.lit(1).cast("long")
    marked = rows.withColumns(
        {"_class": F.col(by) if by else F.lit(0), "_order": seeded_key(F.col(key), seed), "_weight": weight}
    )
    digits, cuts = _COARSE, _find_cuts(marked.withColumn("_base", F.lit(0).cast("long")), n, _COARSE)
    if cuts.where(F.col("_rows") > FINE_ROWS).limit(1).count():
        inside = _attach(marked, cuts, by).where(F.left("_order", F.lit(_COARSE)) == F.col("_cut"))
        digits, cuts = _FINE, _find_cuts(inside.withColumn("_base", F.col("_before")), n, _FINE)
    # A class without a cut is smaller than the quota and is taken whole.
    near = _attach(marked, cuts, by).withColumn("_slice", F.left("_order", F.lit(digits)))
    near = near.where(F.col("_cut").isNull() | (F.col("_slice") <= F.col("_cut")))
    if merge:
        near = near.groupBy(*[c for c in near.columns if c != "_weight"]).agg(F.sum("_weight").alias("_weight"))
    whole = F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut"))
    # Rows that are taken anyway are spread over fine slices.
    near = near.withColumn("_spot", F.when(whole, F.left("_order", F.lit(_FINE))).otherwise(F.col("_slice")))
    ahead = Window.partitionBy("_class", "_spot").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = near.withColumn("_ahead", F.coalesce(F.sum("_weight").over(ahead), F.lit(0)))
    taken = F.when(whole, F.col("_weight")).otherwise(F.least(F.col("_weight"), F.lit(n) - F.col("_before") - F.col("_ahead")))
    kept = ranked.withColumn("_taken", taken).where(F.col("_taken") > 0)
    columns = [*rows.columns, copies] if merge else rows.columns
    return kept.select(*[F.col("_taken").alias(c) if c == copies else F.col(c) for c in columns])


def write_out_copies(rows: DataFrame, copies: str = "copies") -> DataFrame:
    """One row per copy. A row with very many is first split into blocks that
    are spread over the tasks, so neither an array nor a task grows with it."""
    stored = materialise(rows, "copies")
    kept = [c for c in rows.columns if c != copies]
    one, size = F.lit(1).cast("long"), F.lit(COPY_BLOCK).cast("long")

    def expand(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_copy", F.explode(F.sequence(one, F.col(copies)))).select(*kept)

    blocks = (
        stored.where(F.col(copies) > size)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {COPY_BLOCK}"))))
        .withColumn(copies, F.least(size, F.col(copies) - F.col("_block") * size))
        .repartition(*kept, "_block")
    )
    return expand(stored.where(F.col(copies) <= size)).unionByName(expand(blocks))


def head_n(rows: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` smallest rows by the unique ``key``, sorted; rows with a null key
    are left out, whatever ``n``.

    The n-th key is found from the key column alone and becomes a filter that
    the scan can use; then at most ``n`` whole rows are sorted. For a large
    ``n`` the sorted keys are numbered instead of meeting in one heap.
    """
    if n <= 0:
        return rows.limit(0)
    keys = rows.select(key).where(F.col(key).isNotNull())
    if n <= HEAP_ROWS:
        last = keys.orderBy(key).limit(n).agg(F.max(key).alias("k")).first()["k"]
        return rows.where(F.col(key) <= F.lit(last)).orderBy(key).limit(n)
    last = numbered_keys(keys, "_seq").where(F.col("_seq") < n).agg(F.max(key).alias("k")).first()["k"]
    return rows.where(F.col(key) <= F.lit(last)).orderBy(key)


def crawl_pick(entries: DataFrame, quota: int, seed: int = 42) -> DataFrame:
    """As many crawl entries as the quota asks, in seeded order; 0 gives none.

    The copies taken of an equal (url, filename) entry are written out again.
    """
    named = entries.select("url", "filename", F.concat("url", F.lit(" "), "filename").alias("entry"))
    picked = exact_sample(named, quota, "entry", seed=seed, copies="copies", merge=True)
    return write_out_copies(picked).select("url", "filename")


def balanced_negatives(
    candidates: DataFrame, good: DataFrame, title: str = "title", key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """One candidate per title, not among the good titles, as many as there are
    distinct good titles. Of equal titles the smallest ``key`` stays."""
    wanted = good.select(title).distinct().count()
    novel = anti_join(candidates, good, title)
    unique = novel.groupBy(title).agg(F.min(key).alias(key))
    return exact_sample(unique, wanted, title, seed=seed)


def labelled_union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all sets, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def seeded_shuffle(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Global order by seed: a range sort, no single-task step."""
    return rows.orderBy(seeded_key(F.col(key), seed), key)


def shuffled_position(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``key`` and its place (from 0) in the seeded order."""
    keys = rows.select(seeded_key(F.col(key), seed).alias("_order"), key)
    return numbered_keys(keys, "position").drop("_order")


def test_side(key: Column, fraction: float = 0.2, seed: int = 42) -> Column:
    """True for the rows of the test split; depends on the key alone.

    The draw is independent of the sample order: a sample is the start of that
    order, so splitting by the same hash would put all of it on one side.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:split:"), key.cast("string")).cast("binary"))
    draw = F.conv(F.left(order, F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    return draw < fraction


def train_test_split(rows: DataFrame, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: ``train`` or ``test``; row-local, sizes are approximate."""
    return rows.withColumn("split", F.when(test_side(F.col(key), fraction, seed), "test").otherwise("train"))


def exact_train_test_split(rows: DataFrame, key: str, n_test: int, seed: int = 42) -> DataFrame:
    """As above with exactly ``n_test`` test rows."""
    chosen = exact_sample(rows.select(key), n_test, key, seed=seed).withColumn("split", F.lit("test"))
    return rows.join(broadcast_if_small(chosen), key, "left").fillna("train", ["split"])
