"""Frequent n-grams.

``frequent`` finds the most frequent without shuffling all: a task counts the n-grams of its part and passes on those that have at least half
the wanted share there. Whatever has the share overall has half of it in some
part, and what the other parts hold back is less than half the share; so what is
passed on, summed up, finds all of them, and few others.

``widespread`` counts the texts of every n-gram exactly, four bytes each.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .words import SLICE_BYTES, mixed, slices, thrifty


def frequent(docs: DataFrame, text: str, grams: Callable, share: float) -> np.ndarray:
    """Sorted hashes of the n-grams that make up at least ``share`` of all (and
    some others with at least half of it): at most 2 / share, whatever the corpus.

    ``grams(column)`` gives the n-gram hashes of a slice of texts, one array for all.
    """

    def run(batches):
        for batch in batches:
            parts, of = [], 0
            for part in slices(batch, text):
                found = grams(part.column(part.schema.get_field_index(text)))
                of += len(found)
                parts.append(found)
            if not of:
                continue
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            kept = counts >= share * of / 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(values[kept].view(np.int64), 0)), pa.array(np.append(counts[kept], of)), pa.array([False] * int(kept.sum()) + [True])],
                ["gram", "n", "whole"],
            )

    found = docs.select(text).mapInArrow(thrifty(run), "gram long, n long, whole boolean")
    sums = found.groupBy("gram", "whole").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "frequent-grams")
    whole = sums.where("whole").agg(F.sum("n")).first()[0] or 0
    hot = sums.where(~F.col("whole") & (F.col("n") >= share * whole / 2)).select("gram").toArrow()
    return np.sort(hot.column(0).to_numpy().astype(np.int64).view(np.uint64))


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@dataclass
class Widespread:
    """N-grams of many texts, by sorted codes of 32 bits and a bucket."""

    codes: np.ndarray
    buckets: int

    @functools.cached_property
    def _low(self) -> np.ndarray:
        """Which low bits occur: most n-grams need no search."""
        low = np.zeros(1 << min(24, max(10, (8 * len(self.codes)).bit_length())), bool)
        low[self.codes & np.uint64(len(low) - 1)] = True
        return low

    def has(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        if len(self.codes):
            at = np.flatnonzero(self._low[grams & np.uint64(len(self._low) - 1)])
            out[at] = is_in(_codes(grams[at], self.buckets), self.codes)
        return out


NOWHERE = Widespread(np.zeros(0, np.uint64), 1)


def _codes(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(grams) % np.uint64(buckets)) << np.uint64(32) | (grams & np.uint64(0xFFFFFFFF))


def widespread(docs: DataFrame, text: str, grams: Callable, texts: float, buckets: int, parts: int, most: int | None = None) -> Widespread:
    """The n-grams of at least ``texts`` texts. ``grams(column)`` gives the
    distinct n-grams of each text of a slice, in one array.

    Their number is at most that of all texts' n-grams by ``texts``. If there are
    more than ``most``, those of at least as many more texts as leave no more than that.
    """

    def send(batches):
        for batch in batches:
            for part in slices(batch, text, 2 * SLICE_BYTES):
                codes = np.concatenate([grams(p.column(p.schema.get_field_index(text))) for p in slices(part, text)])
                codes = np.sort(_codes(codes, buckets))
                bounds = np.searchsorted(codes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                low = codes.astype(np.uint32)
                full = np.flatnonzero(np.diff(bounds)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([low[bounds[b] : bounds[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "low"]
                )

    def receive(batches):
        held, bucket = [], None
        for batch in batches:
            for number, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != bucket and held:
                    yield count(bucket, held)
                    held = []
                bucket = number
                held.append(np.frombuffer(low.as_py(), np.uint32))
        if held:
            yield count(bucket, held)

    def count(bucket, held):
        values = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        number = np.diff(np.append(first, len(values)))
        many = number >= texts
        return pa.RecordBatch.from_arrays([pa.array(bucket << 32 | values[first[many]].astype(np.int64)), pa.array(number[many])], ["code", "n"])

    sent = docs.select(text).mapInArrow(thrifty(send), "bucket int, low binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = sent.mapInArrow(thrifty(receive), "code long, n long")
    if most is not None:
        found = materialise(found, "widespread")
        levels = found.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("c")).collect()
        left, texts = 0, (1 << 16) + 1
        for n, c in sorted(levels, reverse=True):
            left += c
            if left > most:
                break
            texts = n
        found = found.where(F.col("n") >= texts)
    found = found.select("code").toArrow()
    return Widespread(np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64)), buckets)
