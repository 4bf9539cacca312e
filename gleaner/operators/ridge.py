"""Least squares with a penalty, for a whole grid of penalties from one pass.

Each task adds up the products of its rows (features, the constant and the label)
block by block; the blocks are summed in two rounds, so that no task receives more
than its share. One eigendecomposition of the centred products then gives the fit
for every penalty, and for dependent features without penalty the fit of smallest
norm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FEATURES = 4096  # the products, 8 bytes for each two features, come to the driver
BLOCK = 256  # rows of a block of products
SLAB = 2048  # rows multiplied at a time
FAN = 64  # partial sums of a block after the first round, at most


@dataclass(frozen=True)
class Products:
    """Sums over ``n`` rows of the products of features, of features and label."""

    n: int
    mean: np.ndarray
    label_mean: float
    scatter: np.ndarray  # centred, by n
    pull: np.ndarray  # centred features by centred label, by n


@dataclass(frozen=True)
class Probe:
    """One linear output."""

    penalty: float
    coefficients: np.ndarray
    intercept: float

    def output(self, features: Column | str = "features", sparse: bool = False) -> Column:
        """``features``: an array, or with ``sparse`` the places and values of the
        entries that are not zero."""
        column = F.col(features) if isinstance(features, str) else features
        weights = F.lit([float(w) for w in self.coefficients])
        if sparse:
            terms = F.zip_with(column["at"], column["x"], lambda at, x: x * F.get(weights, at))
        else:
            terms = F.zip_with(column, weights, lambda x, w: x.cast("double") * w)
        return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x) + F.lit(float(self.intercept))


def is_sparse(rows: DataFrame, features: str) -> bool:
    return rows.schema[features].dataType.typeName() == "struct"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of features as a matrix."""
    out = np.zeros((len(column), size))
    if pa.types.is_struct(column.type):
        at, x = (column.field(i) for i in (0, 1))
        row = np.repeat(np.arange(len(column)), np.diff(np.asarray(at.offsets)))
        out[row, np.asarray(at.flatten())] = np.asarray(x.flatten())
    elif len(column):
        out[:] = np.asarray(column.flatten(), float).reshape(len(column), size)
    return out


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of ``part`` (doubles as bytes) by ``keys``, as they stream in."""
    shape = ", ".join(f"{k} int" for k in keys)
    places = list(range(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in held), pa.array([total.tobytes()], pa.binary())], [*keys, "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, part = tuple(batch.column(c)[i].as_py() for c in places), np.frombuffer(batch.column(len(keys))[i].as_py())
                if key != held:
                    if held is not None:
                        yield row()
                    held, total = key, np.zeros(len(part))
                total += part
        if held is not None:
            yield row()

    ordered = parts.select(*keys, "part").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, f"{shape}, part binary")


def products(rows: DataFrame, size: int, features: str = "features", label: str = "label") -> Products:
    """One pass over ``rows``; a null label or feature column is left out. ``size``
    is the number of features."""
    if size > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    wide = size + 2
    found = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    found = found.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), (F.spark_partition_id() % FAN).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLAB):
                part = batch.slice(start, SLAB)
                z = np.ones((part.num_rows, wide))
                z[:, :size] = _matrix(part.column(0), size)
                z[:, -1] = np.asarray(part.column(1))
                total = (0 if total is None else total) + z.T @ z
                place = part.column(2)[0].as_py()
        if total is not None:
            for block, first in enumerate(range(0, wide, BLOCK)):
                values = np.ascontiguousarray(total[first : first + BLOCK]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([place], pa.int32()), pa.array([values], pa.binary())], ["block", "place", "part"])

    parts = _summed(found.mapInArrow(run, "block int, place int, part binary"), ["block", "place"])
    blocks = sorted((r["block"], r["part"]) for r in _summed(parts, ["block"]).collect())  # size by size numbers in all
    if not blocks:
        raise ValueError("no labelled rows")
    total = np.concatenate([np.frombuffer(part).reshape(-1, wide) for _, part in blocks])
    n = total[size, size]
    mean, label_mean = total[:size, size] / n, float(total[size, -1] / n)
    scatter = total[:size, :size] / n - np.outer(mean, mean)
    return Products(int(round(n)), mean, label_mean, scatter, total[:size, -1] / n - mean * label_mean)


def fits(sums: Products, penalties: Sequence[float]) -> list[Probe]:
    """For each penalty the weights that minimise half the mean squared error plus
    half the penalty times their squared norm; the constant is not penalised. Without
    penalty, directions in which the features do not vary get no weight."""
    values, vectors = np.linalg.eigh(sums.scatter) if len(sums.mean) else (np.zeros(0), np.zeros((0, 0)))
    along = vectors.T @ sums.pull
    still = values <= max(values.max(initial=0.0), 0.0) * len(values) * 1e-13
    out = []
    for penalty in penalties:
        strength = np.where(still, penalty, np.maximum(values, 0) + penalty)
        weights = vectors @ np.divide(along, strength, out=np.zeros_like(along), where=(strength > 0) & ~still)
        out.append(Probe(float(penalty), weights, float(sums.label_mean - sums.mean @ weights)))
    return out
