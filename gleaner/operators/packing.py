"""Rows in compressed blocks, one per task's stretch and bucket, for shuffles of
very many short rows: a row in a block takes a few bytes, by itself tens."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20  # rows, or bytes, of a stretch
BLOCK_BYTES = 64 << 20
BUCKET_TEXT = 16 << 20  # bytes of text whose keys a bucket takes, about


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stretches(batches: Iterable[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    """Consecutive batches together, up to a number of rows and bytes."""
    held, count, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        count, size = count + batch.num_rows, size + batch.nbytes
        if count >= rows or size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, count, size = [], 0, 0
    if count:
        yield pa.Table.from_batches(held)


def pressed(batch: pa.RecordBatch) -> tuple[bytes, int]:
    """A block and its length when opened; the schema is not part of it."""
    raw = batch.serialize()
    return pa.compress(raw, "zstd", asbytes=True), raw.size


def opened(block: bytes, length: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(block, length, "zstd"), schema)


def by_bucket(bucket: np.ndarray, table: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    batch = table.take(pa.array(order)).combine_chunks().to_batches()[0]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), batch.slice(a, b - a)


def counted(keys: DataFrame, buckets: int) -> DataFrame:
    """``key`` and ``n``, how often it occurs in the strings ``key``. Tasks count
    stretches of their rows; a bucket's blocks are summed in one task, so hot keys
    weigh no more than others."""

    def send(batches):
        for table in stretches(batches):
            found = table.group_by(["bucket", "key"]).aggregate([([], "count_all")]).rename_columns(["bucket", "key", "n"])
            out = [(b, *pressed(rows)) for b, rows in by_bucket(found.column("bucket").to_numpy(), found.select(["key", "n"]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def receive(batches):
        total, held, count = None, [], 0
        for batch in batches:
            for block, length in zip(batch.column("block"), batch.column("length").to_pylist(), strict=True):
                held.append(opened(block.as_py(), length, parts))
                count += held[-1].num_rows
                if count > 2 * BLOCK_ROWS + 2 * (total.num_rows if total else 0):
                    total, held, count = _summed(held, total), [], 0
        if held:
            total = _summed(held, total)
        if total:
            yield from total.to_batches(max_chunksize=100_000)

    kinds, names = (pa.int32(), pa.binary(), pa.int64()), ["bucket", "block", "length"]
    parts = pa.schema([("key", pa.string()), ("n", pa.int64())])
    dealt = keys.where("key IS NOT NULL").select(bucket_of(F.col("key"), buckets).alias("bucket"), "key")
    sent = dealt.mapInArrow(send, "bucket int, block binary, length long").repartitionById(buckets, "bucket")
    return sent.mapInArrow(receive, "key string, n long")


def _summed(batches: list[pa.RecordBatch], total: pa.Table | None) -> pa.Table:
    table = pa.concat_tables([pa.Table.from_batches(batches), *([total] if total else [])])
    return table.group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])
