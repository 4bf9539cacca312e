"""Connected components of graphs of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .words import thrifty

EDGES = 300_000  # that one task takes


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node of
    ``edges`` (columns ``u``, ``v``, ASCII strings).

    Edges are dealt to tasks of about ``EDGES`` by their first node; each task
    replaces its edges by a star per component it sees. Usually a round or two
    leaves few enough for one task, whose stars are the answer. Where that does
    not shrink the edges, alternating stars go on over all tasks.
    """
    edges = materialise(edges.where("u != v").select("u", "v"), "edges")
    n = edges.count()
    while n > EDGES:
        parts = -(-n // EDGES)
        shrunk = materialise(_contracted(edges.repartitionById(parts, F.pmod(F.xxhash64("u"), parts).cast("int"))), "edges")
        before, n, edges = n, shrunk.count(), shrunk
        if n > 0.7 * before:
            return _labels(_stars(edges))
    return _labels(_contracted(edges.coalesce(1) if n else edges))


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars around the least nodes of its components."""

    def run(batches):
        ends = [(b.column(0), b.column(1)) for b in batches if b.num_rows]
        if not ends:
            return
        u, v = (pa.chunked_array([e[i] for e in ends]).combine_chunks() for i in (0, 1))
        names = pc.unique(pa.concat_arrays([u, v]))
        names = names.take(pc.sort_indices(names))
        roots = local_roots(len(names), *(pc.index_in(x, names).to_numpy(zero_copy_only=False) for x in (u, v)))
        other = np.flatnonzero(roots != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(other)), names.take(pa.array(roots[other]))], ["u", "v"])

    return edges.mapInArrow(thrifty(run), "u string, v string")


def _labels(stars: DataFrame) -> DataFrame:
    stars = materialise(stars.select("u", "v"), "stars")
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def _stars(edges: DataFrame) -> DataFrame:
    """Edges from each node to the least one of its component. Each round shuffles
    the edges that are left twice; rounds grow with the logarithm of the longest
    path. A node's edges are reduced to their minimum map-side, so hubs do no harm."""
    before = None
    while True:
        large = _star(edges.union(edges.select("v", "u")), "v > u")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        edges = materialise(_star(down, "true", True).where("u != v").distinct(), "edges")
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if state == before:
            return edges
        before = state


def _star(edges: DataFrame, condition: str, own: bool = False) -> DataFrame:
    """Each edge's far end is tied to the least of its node's neighbours and the
    node itself; with ``own`` the node too."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    tied = edges.where(condition).join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))) if own else tied


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least member of each of the nodes ``0..n-1``'s components, in one task."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)], np.int64)
