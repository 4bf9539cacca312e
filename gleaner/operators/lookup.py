"""Per-row sums of weights looked up for many keys (tokens, n-grams).

A token model grows with the corpus and its keys are extremely uneven. The
weights are therefore split by frequency: the frequent head, cut to fit a byte
budget, is broadcast and absorbs nearly all occurrences, hot keys included.
Only occurrences of the rare rest are shuffled, in compressed blocks: once to
the weights of their keys and once, as sums, back to their rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import BROADCAST_BYTES
from .packing import BLOCK_ROWS, bucket_of, by_bucket, opened, pressed, stretches

_ROW_BYTES = 64  # hash-relation overhead of a row
_NEVER = 62  # no key occurs 2^62 times


@dataclass(frozen=True)
class SplitWeights:
    head: DataFrame
    tail: DataFrame | None
    below: int = 1  # keys of the tail occur less often than this
    rare: int = 0  # number of keys of the tail


def split_weights(weights: DataFrame, budget: int = BROADCAST_BYTES) -> SplitWeights:
    """Split ``key, n, <weights>`` rows by frequency ``n``; ``weights`` should
    be a stored table.

    Rows and bytes are counted per power of two of ``n``. That histogram has at
    most 64 rows and is read on the driver; the head takes the most frequent
    classes that fit the budget.
    """
    magnitude = F.length(F.bin("n")) - 1
    size = F.sum((F.octet_length("key") + _ROW_BYTES + 8 * (len(weights.columns) - 2)).cast("long"))
    classes = weights.groupBy(magnitude.alias("m")).agg(size.alias("bytes"), F.count("*").alias("c")).collect()
    histogram = {r["m"]: r["bytes"] for r in classes}
    lowest, used = _NEVER, 0
    for m in sorted(histogram, reverse=True):
        used += histogram[m]
        if used > budget:
            break
        lowest = m
    if lowest <= min(histogram, default=lowest):
        return SplitWeights(weights.drop("n"), None)
    frequent = F.col("n") >= F.lit(1 << lowest)
    rare = sum(r["c"] for r in classes if r["m"] < lowest)
    return SplitWeights(weights.where(frequent).drop("n"), weights.where(~frequent).drop("n"), 1 << lowest, rare)


def lookup_sums(
    occurrences: DataFrame,
    row_id: str,
    weights: DataFrame,
    budget: int = BROADCAST_BYTES,
    keys: tuple[str, ...] = ("key",),
) -> DataFrame:
    """Per ``row_id``: ``n`` occurrences and the sum of each weight column.

    ``occurrences`` holds one row per occurrence with one or more ``keys`` to
    look up; a key without weights adds nothing. All occurrences of a row come
    from one task, so what the head absorbs leaves it as about one record per
    row.

    With a tail, the same pass hands on the keys the head does not know, in blocks
    by bucket of the key. There they meet the tail's weights, and what these add
    goes back in blocks to where a stretch of rows is summed up.
    """
    split = split_weights(weights, budget)
    values = [c for c in split.head.columns if c != "key"]
    found = occurrences
    for i, key in enumerate(keys):
        head = split.head.select(F.col("key").alias(f"_k{i}"), *[F.col(v).alias(f"_{v}_{i}") for v in values])
        found = found.join(F.broadcast(head), F.col(key) == F.col(f"_k{i}"), "left")
    absorbed = {
        v: reduce(add, [F.coalesce(F.col(f"_{v}_{i}"), F.lit(0.0)) for i in range(len(keys))]) for v in values
    }
    sums = [F.sum(v).alias(v) for v in values]
    if split.tail is None:
        flat = found.select(row_id, *[c.alias(v) for v, c in absorbed.items()])
        return flat.groupBy(row_id).agg(F.count("*").alias("n"), *sums)

    spark = occurrences.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-split.rare // BLOCK_ROWS))
    unknown = []
    for i, key in enumerate(keys):
        missing = F.col(f"_k{i}").isNull() & F.col(key).isNotNull()
        unknown += [F.when(missing, bucket_of(F.col(key), buckets)).alias(f"b{i}"), F.when(missing, F.col(key)).alias(f"k{i}")]
    known = [absorbed[v].alias(f"v{j}") for j, v in enumerate(values)]
    flat = found.select(F.col(row_id).alias("row"), *known, *unknown)
    rare = split.tail.select(bucket_of(F.col("key"), buckets).alias("b"), "key", *[F.col(v).cast("double").alias(f"v{j}") for j, v in enumerate(values)])
    full = _looked_up(flat, rare, len(keys), len(values), buckets)
    return full.groupBy(F.col("row").alias(row_id)).agg(F.sum("n").alias("n"), *[F.sum(f"v{j}").alias(v) for j, v in enumerate(values)])


def _looked_up(flat: DataFrame, rare: DataFrame, keys: int, values: int, buckets: int) -> DataFrame:
    """``row``, ``n`` and ``v0``.., a few records for each row, whose sums are the
    row's. ``flat`` has an occurrence per row: ``row``, the weights it is known to
    have and the buckets ``b0``.. and strings ``k0``.. of its unknown keys."""
    names = [f"v{j}" for j in range(values)]
    row = T.StructField("row", flat.schema["row"].dataType)
    sums = [T.StructField("n", T.LongType()), *[T.StructField(v, T.DoubleType()) for v in names]]
    sent = T.StructType(
        [
            T.StructField("place", T.LongType()), T.StructField("weights", T.BooleanType()), T.StructField("home", T.LongType()),
            T.StructField("block", T.BinaryType()), T.StructField("length", T.LongType()), row, *sums,
        ]
    )
    asked = lambda kind: pa.schema([("row", kind), ("key", pa.string())])
    given = pa.schema([("key", pa.string()), *[(v, pa.float64()) for v in names]])
    added = lambda kind: pa.schema([("row", kind), *[(v, pa.float64()) for v in names]])

    def record(kind, places, weights, home, blocks):
        k = len(places)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(places, pa.int64()), pa.array([weights] * k, pa.bool_()), pa.array(home, pa.int64()), pa.array([b for b, _ in blocks], pa.binary()),
                pa.array([n for _, n in blocks], pa.int64()), pa.nulls(k, kind), *[pa.nulls(k, x) for x in (pa.int64(), *[pa.float64()] * values)],
            ],
            sent.names,
        )

    def summed(table):
        return table.group_by("row").aggregate([([], "count_all"), *[(v, "sum") for v in names]])

    def own(home, table, n):
        """Sums by row, as they are."""
        rows = table.num_rows
        at = pa.array(np.full(rows, home), pa.int64())
        columns = [at, pa.array([False] * rows, pa.bool_()), at, pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int64()), table.column("row"), n, *[table.column(f"{v}_sum") for v in names]]
        yield from pa.table(columns, names=sent.names).combine_chunks().to_batches(max_chunksize=100_000)

    def ask(batches):
        part = TaskContext.get().partitionId()
        for number, table in enumerate(stretches(batches)):
            home, kind = part * 1_000_003 + number, table.schema.field("row").type
            mine = summed(table)
            yield from own(home, mine, mine.column("count_all"))
            parts = [table.select(["row", f"b{i}", f"k{i}"]).filter(pc.is_valid(table.column(f"b{i}"))).rename_columns(["row", "b", "key"]) for i in range(keys)]
            missing = pa.concat_tables(parts)
            out = [(b, pressed(rows)) for b, rows in by_bucket(missing.column("b").to_numpy(), missing.select(["row", "key"]))]
            yield record(kind, [b for b, _ in out], False, [home] * len(out), [x for _, x in out])

    def give(batches):
        for table in stretches(batches):
            out = [(b, pressed(rows)) for b, rows in by_bucket(table.column("b").to_numpy(), table.select(["key", *names]))]
            yield record(row_kind, [b for b, _ in out], True, [None] * len(out), [x for _, x in out])

    def answer(batches):
        lists, table, held, homes, count = [], None, [], [], 0

        def reply():
            at = pc.index_in(pa.concat_arrays([b.column("key") for b in held]), table.column("key")) if table else pa.nulls(count, pa.int32())
            kind, start, places, out = held[0].schema.field("row").type, 0, [], []
            for batch, home in zip(held, homes, strict=True):
                found = at.slice(start, batch.num_rows)
                start += batch.num_rows
                seen = pc.is_valid(found)
                if pc.any(seen).as_py():
                    picked = table.select(names).take(found.filter(seen)).combine_chunks()
                    columns = [batch.column("row").filter(seen), *[c.chunk(0) for c in picked.columns]]
                    places.append(home)
                    out.append(pressed(pa.RecordBatch.from_arrays(columns, schema=added(kind))))
            return record(kind, places, False, places, out)

        for batch in batches:
            kind = batch.schema.field("row").type
            blocks = batch.column("block")
            plain = pc.is_null(blocks)
            if pc.any(plain).as_py():
                yield batch.filter(plain)
            for i in np.flatnonzero(pc.is_valid(blocks).to_numpy(zero_copy_only=False)).tolist():
                block, length = blocks[i].as_py(), batch.column("length")[i].as_py()
                if batch.column("weights")[i].as_py():  # these come first
                    lists.append(opened(block, length, given))
                    continue
                if lists:
                    table, lists = pa.Table.from_batches(lists).combine_chunks(), []
                held.append(opened(block, length, asked(kind)))
                homes.append(batch.column("home")[i].as_py())
                count += held[-1].num_rows
                if count >= BLOCK_ROWS:
                    yield reply()
                    held, homes, count = [], [], 0
        if held:
            yield reply()

    def gather(batches):
        def tables():
            for batch in batches:
                blocks = batch.column("block")
                kind = batch.schema.field("row").type
                plain = batch.filter(pc.is_null(blocks))
                if plain.num_rows:
                    yield plain.select(["row", "n", *names])
                for i in np.flatnonzero(pc.is_valid(blocks).to_numpy(zero_copy_only=False)).tolist():
                    rows = opened(blocks[i].as_py(), batch.column("length")[i].as_py(), added(kind))
                    n = pa.array(np.zeros(rows.num_rows, np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(0), n, *rows.columns[1:]], ["row", "n", *names])

        for table in stretches(tables()):
            total = table.group_by("row").aggregate([(c, "sum") for c in ("n", *names)]).select(["row", *[f"{c}_sum" for c in ("n", *names)]])
            yield from total.rename_columns(["row", "n", *names]).combine_chunks().to_batches(max_chunksize=100_000)

    asks = flat.mapInArrow(ask, sent)
    row_kind = _arrow_kind(flat)
    both = rare.mapInArrow(give, sent).unionByName(asks)
    both = both.repartitionById(buckets, F.pmod("place", F.lit(buckets)).cast("int")).sortWithinPartitions(F.col("weights").desc())
    back = both.mapInArrow(answer, sent)
    back = back.repartitionById(buckets, F.pmod(F.xxhash64("home"), F.lit(buckets)).cast("int"))
    return back.mapInArrow(gather, T.StructType([row, *sums]))


def _arrow_kind(flat: DataFrame) -> pa.DataType:
    return flat.select("row").limit(0).toArrow().schema.field("row").type
