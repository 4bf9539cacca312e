"""Hard negatives from an STR-packed R-tree over integer vectors.

Sort-tile-recursive packing sorts by label, then by the coordinates of largest
variance: quantiles over all rows give tiles of about ``tile`` rows, and inside a
task a tile is packed into leaves of ``LEAF`` rows and nodes of ``FANOUT``
children. A node has a minimum bounding box (and the range of its labels). For an
anchor ``q`` the inner products in a box lie between the sums over coordinates of
``min(q * low, q * high)`` and ``max(q * low, q * high)``. The search pops the
queued node with the largest upper bound, for many anchors at a time, and leaves
out nodes outside all score windows of the anchor or strictly below the k-th score
it has found.

An anchor is searched in its own tile first; what it finds there prunes the other
tiles. Tiles that remain get the anchor as a row, so neither the vectors nor the
anchors pass the driver; the driver holds one box a tile. Results of tiles are
merged by a limit per anchor before the shuffle.

Inner products are exact: single precision where every product sum stays below
2**24, double precision below 2**53, and Python integers (without pruning) beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.runtime import materialise

from .words import mixed

TILE_MOST, TILE_LEAST, TILES = 65_536, 256, 64  # rows of a tile; tiles that small tables are cut into
LEAF, FANOUT = 128, 16
CHUNK = 128  # anchors searched at a time
ANCHORS_A_TASK = 65_536
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
_GRID = [i / 256 for i in range(1, 256)]
_LEAST, _MOST = -(2**63), 2**63 - 1
_NONE = _LEAST  # score of a place that is not filled


@dataclass(frozen=True)
class Shape:
    """What all tasks know of the vectors: dimensions and exact number type."""

    dim: int
    kind: str  # f4, f8, or O for Python integers

    @property
    def stored(self) -> np.dtype:
        return np.dtype("<f4" if self.kind == "f4" else "<f8")

    def read(self, column: pa.Array) -> np.ndarray:
        flat = np.frombuffer(b"".join(column.to_pylist()), self.stored)
        found = flat.reshape(len(column), self.dim) if self.dim else np.zeros((len(column), 0), self.stored)
        return found if self.kind != "O" else np.frompyfunc(int, 1, 1)(found).reshape(found.shape)


def scaled(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``floor(256 * x)`` of list entries, and the lengths of the lists; with
    ``dim`` as a matrix, short lists filled up with zeros."""
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    flat = np.floor(SCALE * np.asarray(column.flatten().cast(pa.float64()), float))
    if dim is None:
        return flat, size
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out, size


def usable(vector: Column) -> Column:
    """A vector whose scaled components are all finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _measured(rows: DataFrame) -> tuple[int, Shape, list[int]]:
    """Number of rows, shape, and the two coordinates of largest variance, from
    sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares, top = 0, np.zeros(0), np.zeros(0), 0.0
        for batch in batches:
            flat, size = scaled(batch.column(2))
            count += len(size)
            if len(flat) == 0:
                continue
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            with np.errstate(over="ignore"):
                parts = [np.bincount(place, flat, len(sums)), np.bincount(place, flat**2, len(sums))]
            sums = np.pad(sums, (0, len(parts[0]) - len(sums))) + parts[0]
            squares = np.pad(squares, (0, len(parts[1]) - len(squares))) + parts[1]
            top = max(top, float(np.abs(flat).max()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(-1, len(sums))), pa.array(np.full(len(sums) + 1, count)),
                pa.array(np.concatenate([[0], sums])), pa.array(np.concatenate([[0], squares])), pa.array(np.full(len(sums) + 1, top)),
            ],
            ["i", "n", "s", "q", "top"],
        )

    parts = rows.mapInArrow(run, "i long, n long, s double, q double, top double")
    by_place = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("top").alias("top"))
    found = sorted(by_place.collect(), key=lambda r: r["i"])  # one row a coordinate
    if not found:
        return 0, Shape(0, "f4"), []
    total, dim, top = found[0]["n"], found[-1]["i"] + 1, max(r["top"] for r in found)
    reach = int(top) ** 2 * max(dim, 1)
    spread = {r["i"]: r["q"] - r["s"] ** 2 / total for r in found[1:]}
    widest = sorted(spread, key=lambda i: (-spread[i] if math.isfinite(spread[i]) else -math.inf, i))[:2]
    return total, Shape(dim, "f4" if reach < 2**24 else "f8" if reach < 2**53 else "O"), widest


def tile_rows(total: int) -> int:
    return min(TILE_MOST, max(TILE_LEAST, -(-total // TILES)))


def _cuts(points: DataFrame, by: list[str], column: str, parts) -> dict[tuple, list[float]]:
    """Per group the values that cut ``column`` into ``parts(rows)`` slabs."""
    grid = F.percentile_approx(column, F.array(*map(F.lit, _GRID)), F.lit(2_000)).alias("grid")
    out = {}
    for row in points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), grid).collect():  # one row a slab
        number = parts(row["n"])
        chosen = [row["grid"][min(len(_GRID), max(1, round(256 * i / number))) - 1] for i in range(1, number)]
        out[tuple(row[c] for c in by)] = sorted(set(chosen))
    return out


def _slab(values: np.ndarray, groups: list[np.ndarray], cuts: dict[tuple, list[float]]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    keys = np.stack(groups, 1) if groups else np.zeros((len(values), 0), np.int64)
    for key in np.unique(keys, axis=0) if groups else [()]:
        here = (keys == key).all(1)
        out[here] = np.searchsorted(cuts.get(tuple(int(k) for k in key), []), values[here], "left")
    return out


def tiled(rows: DataFrame, tile: int | None = None) -> tuple[DataFrame, Shape]:
    """``(tile, row, id, label, v)`` of ``rows`` (``id``, ``label``, ``vector``):
    tiles by quantiles of the label and of the two widest coordinates; a tile that
    equal values make too large is dealt out by a hash."""
    total, shape, widest = _measured(rows)
    spark = rows.sparkSession
    size = tile or tile_rows(total)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, _ = scaled(batch.column(2), shape.dim)
            at = [values[:, i] if i < shape.dim else np.zeros(len(values)) for i in (*widest, shape.dim, shape.dim)[:2]]
            packed = values.astype(shape.stored)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(0), batch.column(1), pa.array(at[0]), pa.array(at[1]), pa.array([v.tobytes() for v in packed], pa.binary())],
                ["row", "id", "label", "x", "y", "v"],
            )

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    points = materialise(numbered.mapInArrow(encode, "row long, id long, label long, x double, y double, v binary"), "negatives-points")
    first = _cuts(points, [], "label", lambda n: math.ceil((n / size) ** (1 / 3))) if total else {}

    def place(column: str, groups: list[str], cuts: dict, name: str, frame: DataFrame) -> DataFrame:
        """``frame`` with the slab of each row; cuts are as many as tiles at most."""
        shape_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.asarray(batch.column(column), float)
                slab = _slab(values, [np.asarray(batch.column(g)) for g in groups], cuts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab)], [*batch.schema.names, name])

        return frame.mapInArrow(run, f"{shape_of}, {name} long")

    one = place("label", [], first, "a", points)
    narrow = one.select("a", "x", "y")
    second = _cuts(narrow, ["a"], "x", lambda n: math.ceil((n / size) ** 0.5))
    two = place("x", ["a"], second, "b", one)
    third = _cuts(two.select("a", "b", "y"), ["a", "b"], "y", lambda n: math.ceil(n / size))
    three = place("y", ["a", "b"], third, "c", two)
    counted = three.groupBy("a", "b", "c").count().orderBy("a", "b", "c").collect()  # one row a tile
    parts = {(r["a"], r["b"], r["c"]): -(-r["count"] // (2 * size)) for r in counted}
    begin = dict(zip(parts, np.concatenate([[0], np.cumsum(list(parts.values()), dtype=np.int64)]).tolist(), strict=False))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in "abc"), strict=True))
            salt = mixed(np.asarray(batch.column("row")).astype(np.uint64)) >> np.uint64(1)
            deal = salt.astype(np.int64) % np.array([parts[k] for k in keys], np.int64) if keys else np.zeros(0, np.int64)
            tiles = np.array([begin[k] for k in keys], np.int64) + deal
            yield pa.RecordBatch.from_arrays([pa.array(tiles), *(batch.column(c) for c in ("row", "id", "label", "v"))], ["tile", "row", "id", "label", "v"])

    found = three.mapInArrow(number, "tile long, row long, id long, label long, v binary")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return materialise(found.repartition(width, "tile"), "negatives-tiles"), shape


@dataclass
class Boxes:
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # smallest and largest label
    last: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible inner product of each row of ``q`` with a
        point of each box."""
        if q.dtype == object:
            wide = np.full((len(q), len(self.low)), np.inf)
            return -wide, wide
        up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        low, high = self.low.T.astype(float), self.high.T.astype(float)
        return up @ low + down @ high, up @ high + down @ low

    def admits(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether a box can hold a row of the same label, or of another."""
        if same:
            return (self.first <= labels[:, None]) & (labels[:, None] <= self.last)
        return (self.first != labels[:, None]) | (self.last != labels[:, None])


def _boxes(tiles: DataFrame, shape: Shape) -> tuple[list[int], Boxes]:
    """The box of each tile: one row a tile and task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            values, labels = shape.read(batch.column("v")).astype(float), np.asarray(batch.column("label"))
            tile = np.asarray(batch.column("tile"))
            for t in np.unique(tile):
                here = tile == t
                now = [values[here].min(0), values[here].max(0), labels[here].min(), labels[here].max()]
                old = found.get(int(t))
                found[int(t)] = now if old is None else [f(x, y) for f, x, y in zip((np.minimum, np.maximum, min, max), old, now, strict=True)]
        for t, (low, high, first, last) in found.items():
            yield pa.RecordBatch.from_pydict({"tile": [t], "low": [low.tobytes()], "high": [high.tobytes()], "first": [int(first)], "last": [int(last)]})

    merged: dict[int, list] = {}
    for r in tiles.mapInArrow(run, "tile long, low binary, high binary, first long, last long").collect():
        now = [np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["first"], r["last"]]
        old = merged.get(r["tile"])
        merged[r["tile"]] = now if old is None else [f(x, y) for f, x, y in zip((np.minimum, np.maximum, min, max), old, now, strict=True)]
    names = sorted(merged)
    low, high = (np.array([merged[t][i] for t in names]).reshape(len(names), shape.dim) for i in (0, 1))
    return names, Boxes(low, high, *(np.array([merged[t][i] for t in names], np.int64) for i in (2, 3)))


def _packed(order: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    """Sort-tile-recursive: leaves of at most ``LEAF`` rows."""
    if len(order) <= LEAF:
        return [order]
    if not keys:
        return [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    slabs = math.ceil((len(order) / LEAF) ** (1 / len(keys)))
    wide = LEAF * math.ceil(len(order) / LEAF / slabs)
    order = order[np.argsort(keys[0][order], kind="stable")]
    return [leaf for i in range(0, len(order), wide) for leaf in _packed(order[i : i + wide], keys[1:])]


class Tree:
    """An R-tree over the rows of a tile. Nodes are numbered from the leaves up."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        spread = values.astype(float).var(0) if len(values) else np.zeros(0)
        widest = np.argsort(-spread, kind="stable")[:2]
        leaves = _packed(np.arange(len(ids)), [labels, *(values[:, i].astype(float) for i in widest)])
        order = np.concatenate(leaves)
        self.values, self.ids, self.labels = values[order], ids[order], labels[order]
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        plain = self.values.astype(float) if values.dtype == object else self.values
        starts = self.begin[:-1]
        level = [np.minimum.reduceat(plain, starts), np.maximum.reduceat(plain, starts), np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)]
        levels, self.children, base = [level], {}, 0
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FANOUT)
            for i, s in enumerate(starts):
                self.children[base + len(level[0]) + i] = np.arange(base + s, base + min(s + FANOUT, len(level[0])))
            base += len(level[0])
            level = [f.reduceat(x, starts) for f, x in zip((np.minimum, np.maximum) * 2, level, strict=True)]
            levels.append(level)
        self.boxes = Boxes(*(np.concatenate([x[i] for x in levels]) for i in range(4)))
        self.visited = 0  # leaves read, by anchor

    def search(self, q, own, labels, low, high, best, same: bool) -> np.ndarray:
        """For each anchor and window the first k of ``best`` (score and id of what
        was found elsewhere) and the tree's rows: of the anchor's label but not of
        its id (``same``), or of other labels; scores in ``[low, high]``, larger
        scores and smaller ids first."""
        rows, windows, k, _ = best.shape
        least, most = self.boxes.bounds(q)
        floor = np.maximum(low, best[:, :, k - 1, 0])  # the k-th score, or the window's end
        open_to = np.zeros(most.shape, bool)
        for w in range(windows):
            wanted = (low[:, w] <= high[:, w])[:, None]
            open_to |= wanted & (most >= floor[:, w, None]) & (least <= high[:, w, None])
        open_to &= self.boxes.admits(labels, same)
        most = np.where(open_to, most, -np.inf)
        queue = np.full(most.shape, -np.inf)
        queue[:, -1] = most[:, -1]
        leaves = len(self.begin) - 1
        live = np.arange(rows)
        while len(live):
            node = queue[live].argmax(1)
            bound = queue[live, node]
            lowest = np.where(low[live] <= high[live], floor[live], _MOST).min(1)
            going = (bound > -np.inf) & (bound >= lowest)
            live, node = live[going], node[going]
            queue[live, node] = -np.inf
            for n in np.unique(node):
                who = live[node == n]
                if n >= leaves:
                    children = self.children[int(n)]
                    queue[who[:, None], children] = most[who[:, None], children]
                else:
                    self.visited += len(who)
                    self._leaf(int(n), who, q, own, labels, low, high, floor, best, same)
        return best

    def _leaf(self, n, who, q, own, labels, low, high, floor, best, same) -> None:
        a, b = self.begin[n], self.begin[n + 1]
        if q.dtype == object:
            score = np.clip(q[who] @ self.values[a:b].T, _LEAST + 1, _MOST).astype(np.int64)
        else:
            score = (q[who] @ self.values[a:b].T).astype(np.int64)
        equal = self.labels[a:b] == labels[who][:, None]
        fits = equal & (self.ids[a:b] != own[who][:, None]) if same else ~equal
        k = best.shape[2]
        for w in range(best.shape[1]):
            hit = fits & (score >= floor[who, w, None]) & (score <= high[who, w, None])
            for i in np.flatnonzero(hit.any(1)):
                row, places = who[i], np.flatnonzero(hit[i])
                scores = np.concatenate([best[row, w, :, 0], score[i, places]])
                names = np.concatenate([best[row, w, :, 1], self.ids[a:b][places]])
                first = np.lexsort((names, -np.maximum(scores, _LEAST + 1), scores == _NONE))[:k]
                best[row, w, :, 0], best[row, w, :, 1] = scores[first], names[first]
                floor[row, w] = max(low[row, w], best[row, w, k - 1, 0])


_ANCHOR = "tile long, part long, kind int, row long, id long, label long, v binary, w binary"
_FOUND = "home long, row long, id long, label long, v binary, w binary"


def _state(column: pa.Array, windows: int, k: int) -> np.ndarray:
    """Windows and what was found: ``low``, ``high`` and k pairs (score, id) of each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, windows, 2 + 2 * k).copy()


def _routed(anchors: DataFrame, tiles: list[int], boxes: Boxes, shape: Shape, windows: int, k: int, same: bool, home: bool, parts: int) -> DataFrame:
    """Each anchor (``_FOUND``) once for each tile to be searched: its own tile, or
    the others that can hold something better than what it has."""
    place = {t: i for i, t in enumerate(tiles)}
    step = max(1, (4 << 20) // max(1, len(tiles)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                mine = np.array([place[t] for t in batch.column("home").to_pylist()], np.int64)
                if home:
                    who, where = np.arange(len(mine)), mine
                else:
                    state = _state(batch.column("w"), windows, k)
                    low, high, last = state[:, :, 0], state[:, :, 1], state[:, :, 2 * k]
                    least, most = boxes.bounds(shape.read(batch.column("v")))
                    chosen = np.zeros(most.shape, bool)
                    for w in range(windows):
                        floor = np.maximum(low, last)[:, w, None]
                        chosen |= (low[:, w] <= high[:, w])[:, None] & (most >= floor) & (least <= high[:, w, None])
                    chosen &= boxes.admits(np.asarray(batch.column("label")), same)
                    chosen[np.arange(len(mine)), mine] = False
                    who, where = np.nonzero(chosen)
                    state[:, :, 0], state[:, :, 2::2] = np.maximum(low, last), _NONE  # only what is as good
                    batch = batch.set_column(batch.schema.get_field_index("w"), "w", pa.array([x.tobytes() for x in state], pa.binary()))
                for lo in range(0, len(who), 2_000):
                    now, there = who[lo : lo + 2_000], where[lo : lo + 2_000]
                    part = mixed(np.asarray(batch.column("row"))[now].astype(np.uint64)) % np.uint64(parts)
                    copied = batch.take(pa.array(now))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(tiles, np.int64)[there]), pa.array(part.astype(np.int64)), pa.array(np.ones(len(now), np.int32)),
                            *(copied.column(c) for c in ("row", "id", "label", "v", "w")),
                        ],
                        ["tile", "part", "kind", "row", "id", "label", "v", "w"],
                    )

    return anchors.mapInArrow(run, _ANCHOR)


def _searched(tiles: DataFrame, routed: DataFrame, shape: Shape, windows: int, k: int, same: bool, parts: int) -> DataFrame:
    """``_FOUND`` for each routed anchor and tile that gave it something."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    vectors = tiles.select("tile", every.alias("part"), F.lit(0).alias("kind"), "row", "id", "label", "v", F.lit(None).cast("binary").alias("w"))
    # rows of a tile and its anchors meet: bounded by the tile, and by the parts
    met = vectors.unionByName(routed).repartition("tile", "part").sortWithinPartitions("tile", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, tree = None, [], None
        for batch in batches:
            where = np.stack([np.asarray(batch.column(c)) for c in ("tile", "part", "kind")], 1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(where)], strict=True):
                if begin == end:
                    continue
                piece = batch.slice(begin, end - begin)
                key, kind = tuple(where[begin][:2]), where[begin][2]
                if key != at:
                    at, rows, tree = key, [], None
                ids, labels = np.asarray(piece.column("id")), np.asarray(piece.column("label"))
                values = shape.read(piece.column("v"))
                if kind == 0:
                    rows.append((values, ids, labels))
                    continue
                if tree is None:
                    tree, rows = Tree(*(np.concatenate(x) for x in zip(*rows, strict=True))), []
                for lo in range(0, len(ids), CHUNK):
                    part = piece.slice(lo, CHUNK)
                    state = _state(part.column("w"), windows, k)
                    best = state[:, :, 2:].reshape(len(state), windows, k, 2).copy()
                    now = slice(lo, lo + CHUNK)
                    tree.search(values[now], ids[now], labels[now], state[:, :, 0], state[:, :, 1], best, same)
                    state[:, :, 2:] = best.reshape(len(state), windows, 2 * k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("tile"), *(part.column(c) for c in ("row", "id", "label", "v")), pa.array([s.tobytes() for s in state], pa.binary())],
                        ["home", "row", "id", "label", "v", "w"],
                    )

    return met.mapInArrow(run, _FOUND)


def _unpacked(found: DataFrame, windows: int, k: int) -> DataFrame:
    """``(row, anchor_id, window, id, score)`` of what the states hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = _state(batch.column("w"), windows, k)[:, :, 2:].reshape(-1, windows, k, 2)
            who, window, place = np.nonzero(best[..., 0] != _NONE)
            score, name = best[who, window, place].T
            row, own = (np.asarray(batch.column(c))[who] for c in ("row", "id"))
            arrays = [pa.array(np.ascontiguousarray(x)) for x in (row, own, window.astype(np.int64), name, score)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "anchor_id", "window", "id", "score"])

    return found.mapInArrow(run, "row long, anchor_id long, window long, id long, score long")


def _first(tiles: DataFrame, top: tuple[list[int], Boxes, Shape], anchors: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """``(row, anchor_id, window, rank, id, score)``: the first k rows of each
    anchor and window, rank from 1."""
    names, boxes, shape = top
    parts = max(1, -(-anchors.count() // ANCHORS_A_TASK))
    fixed = (shape, windows, k, same)
    home = materialise(_searched(tiles, _routed(anchors, names, boxes, *fixed, True, parts), *fixed, parts), "negatives-home")
    away = _searched(tiles, _routed(home, names, boxes, *fixed, False, parts), *fixed, parts)
    found = _unpacked(home.unionByName(away), windows, k)
    rank = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "id")).alias("rank")
    return found.select("*", rank).where(F.col("rank") <= k)


def _with_windows(anchors: DataFrame, positives: DataFrame | None, windows: int, k: int) -> DataFrame:
    """Anchors with their score windows: all scores, or for each positive the
    scores between ``LOW_PERCENT`` and ``HIGH_PERCENT`` of its own."""
    columns, everything = ["home", "row", "id", "label", "v"], (_LEAST + 1, _MOST) if positives is None else (1, 0)
    if positives is None:
        rows = anchors.select(*columns, F.array().cast("array<long>").alias("scores"))
    else:  # at most one score a window
        listed = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("scores"))
        rows = anchors.join(listed, "row").select(*columns, F.col("scores.score").alias("scores"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = np.zeros((batch.num_rows, windows, 2), np.int64)
            limits[:, :] = everything
            for i, scores in enumerate(batch.column("scores").to_pylist()):
                for w, score in enumerate(scores):
                    limits[i, w] = -(-LOW_PERCENT * score // 100), HIGH_PERCENT * score // 100
            state = np.zeros((batch.num_rows, windows, 2 + 2 * k), "<i8")
            state[:, :, :2] = limits
            state[:, :, 2::2] = _NONE
            packed = pa.array([x.tobytes() for x in state], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), packed], [*columns, "w"])

    return rows.mapInArrow(run, _FOUND)


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
    key="vec_id", label="label", vector="embedding", tile: int | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose key ``every`` divides; their positives the first
    rows of the same label and another key; the negatives of a positive the first
    rows of other labels whose score lies in its window. Scores are inner products
    of ``floor(256 * x)``, larger first, ties by smaller key.

    Rows with a null key, label or vector, or a component that is null or not
    finite (256-fold), take no part. A vector that is shorter than others is filled
    up with zeros, an empty one scores 0 everywhere. Rows are rows: one that is
    repeated is found as often, and an anchor that is repeated gives its rows as
    often. An anchor without positives, a positive without negatives and an empty
    table give no rows. Scores beyond the range of a long are cut to its ends.
    Other columns are not read.
    """
    names = [F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label")]
    rows = vectors.select(*names, F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    tiles, shape = tiled(rows, tile)
    top = (*_boxes(tiles, shape), shape)
    anchors = tiles.where(F.col("id") % every == 0).withColumnRenamed("tile", "home")
    near = _first(tiles, top, _with_windows(anchors, None, 1, positives), 1, positives, True)
    near = materialise(near, "negatives-positives")
    far = _first(tiles, top, materialise(_with_windows(anchors, near, positives, negatives), "negatives-anchors"), positives, negatives, False)
    pairs = near.select("row", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["row", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
