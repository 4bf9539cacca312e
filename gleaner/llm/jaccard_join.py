"""N-gram Jaccard join by vertical partitioning.

Word n-grams have a global order: by a hash, those of many texts last. The order is cut
into fragments and each text's set into segments; overlaps are counted in each
fragment by itself and summed per pair.

1. Candidates. Of two sets alike enough, each has one of the other's n-grams
   among its first few of the order. These alone are dealt out, with their places.
   Two sets that share one are a candidate pair if they are close enough in size
   and what follows the n-gram in either could be enough (it is, at the first that
   they share). A pair is tied if the sets' histograms over hash classes could
   overlap enough: chance pairs fail this, so blocks do not grow together by
   chance. The sets of a long list, or one of a widespread n-gram, are tied without it, those only
   that can have a partner there. What is tied falls into blocks. Most texts are in none and are done.
2. Counts. The sets of a block are cut into segments. A task counts the overlaps of
   one fragment, as a matrix over the block's sets; the matrices are summed, and pairs
   beyond the threshold tied. A block gives a star of links, not all its pairs. Large
   blocks go by chunks of close sizes, each together with the block's hubs, its sets
   of the fewest rare n-grams: originals, which most copies link with. Only what is
   still apart then is compared across chunks, so a large group of near copies does
   not cost the square of its size.
3. Components of these links, and the least key of each.

Equal sets are one node throughout, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialise
from .components import components, local_roots
from .hot import NOWHERE, Widespread, widespread
from .words import cut, mixed, slices, thrifty

SHINGLE, PERCENT = 4, 85
AT_LEAST, WIDE = 8, 2_000_000  # number of texts from which an n-gram comes last in the order; how many such n-grams at most
CHUNK = 1024  # sets in a chunk of a block, about
HUBS = 8  # sets of each size class of a large block that chunks of close sizes are compared with
SLAB = 2048  # columns of a matrix product
FRAGMENT_BITS = 3
LIST = 64  # sets with one n-gram whose pairs are looked at one by one
CLASS = 8  # elements a class of a histogram, at least
_HOT = np.uint64(1 << 63)


def shingle_sets(column: pa.Array, hot: Widespread, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts in one array, each sorted by the global order, and
    their bounds. A text of fewer than ``n`` words has its whole sequence."""
    words = cut(column, lower=True)
    hashes = words.hashes()
    number = np.diff(words.first)
    grams, inside = words.grams(n, hashes)
    for short in range(1, n):
        at = words.first[:-1][number == short]
        if len(at):
            grams[at] = mixed(words.grams(short, hashes)[0][at] ^ np.uint64(short))
            inside[at] = True
    grams = grams[inside]
    keys = grams >> np.uint64(1)
    keys |= np.where(hot.has(keys), _HOT, np.uint64(0))
    bounds = np.concatenate([[0], np.cumsum(inside)])[words.first]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        keys[a:b].sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return keys[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def nodes(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit sum over each set that does not depend on the order; with the
    set's size it names the set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(keys & ~_HOT))])
    return mixed(total[bounds[1:]] - total[bounds[:-1]])


def needed(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap of a set with any other that it links to."""
    return -(-percent * size // 100)


def _named(node: np.ndarray, size: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:x}" for a, b in zip(node.tolist(), size.tolist(), strict=True)]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    own = F.col(f"`{key}`").cast("long")
    return docs.select(own.alias("_key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_hash"), F.col(f"`{text}`").alias("_text"))


def histograms(keys: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Elements of each set by the low bits of their hash, a byte a class (255:
    that many or more). The number of classes is a power of two that grows with
    the set: a chance pair's classes differ by more than links allow."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        classes = 1 << min(10, max(4, ((b - a) // CLASS).bit_length() - 1))
        counts = np.bincount((keys[a:b] & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
        out.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
    return out


def may_link(one: bytes, other: bytes, sizes: tuple[int, int], percent: int) -> bool:
    """Whether sets with these histograms could overlap enough."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    if a.max() == 255 or b.max() == 255:
        return True
    classes = min(len(a), len(b))
    most = np.minimum(a.reshape(-1, classes).sum(0), b.reshape(-1, classes).sum(0)).sum()
    return (100 + percent) * int(most) >= percent * sum(sizes)


_PASSED = "bucket long, block binary, key long, hash long, n long, rare long, node string, root string, sketch binary, sure boolean"
_NAMES = ["bucket", "block", "key", "hash", "n", "rare", "node", "root", "sketch", "sure"]


def _candidates(rows: DataFrame, hot: Widespread, n: int, percent: int, buckets: int) -> DataFrame:
    """Per text ``key``, ``hash``, ``n``, ``rare`` (n-grams that are not widespread),
    ``node`` and ``sketch``; per candidate pair, or surely tied set, ``node`` and ``root``."""

    def send(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "_text"):
                keys, bounds = shingle_sets(part.column(2), hot, n)
                size = np.diff(bounds)
                rare = np.diff(np.concatenate([[0], np.cumsum(keys < _HOT)])[bounds])
                node = nodes(keys, bounds)
                names = _named(node, size)
                m = part.num_rows
                place = mixed(part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(buckets)
                none, nothing = pa.nulls(m, pa.binary()), pa.nulls(m, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place.astype(np.int64)), none, part.column(0), part.column(1), pa.array(size, pa.int64()),
                        pa.array(rare, pa.int64()), pa.array(names, pa.string()), nothing, pa.array(histograms(keys, bounds), pa.binary()), pa.nulls(m, pa.bool_()),
                    ],
                    _NAMES,
                )
                # the first n-grams of each different set
                alone = np.unique(np.stack([node, size.astype(np.uint64)], 1), axis=0, return_index=True)[1] if m else np.zeros(0, np.int64)
                alone = alone[size[alone] > 0]
                length = size[alone] - needed(size[alone], percent) + 1
                row = np.repeat(alone, length)
                step = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
                gram = keys[bounds[row] + step]
                bucket = (mixed(gram) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                row, gram, bucket, step = row[order], gram[order], bucket[order], step[order].astype(np.int32)
                out, at = [], []
                for piece in np.split(np.arange(len(row)), np.flatnonzero(np.diff(bucket)) + 1):
                    if len(piece):
                        own = row[piece]
                        raw = np.int64(len(piece)).tobytes() + gram[piece].tobytes() + node[own].tobytes() + size[own].astype(np.int32).tobytes() + step[piece].tobytes()
                        out.append(press.compress(raw))
                        at.append(int(bucket[piece[0]]))
                k = len(out)
                longs, words = pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.binary()), longs, longs, longs, longs, words, words, pa.nulls(k, pa.binary()), pa.nulls(k, pa.bool_())], _NAMES)

    def receive(batches):
        held, bucket = [], None
        for batch in batches:
            local = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            if local.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(local)).columns[2:], _NAMES[2:])
            for i in np.flatnonzero(~local).tolist():
                number = batch.column(0)[i].as_py()
                if number != bucket and held:
                    yield from _tied(held, percent)
                    held = []
                bucket = number
                held.append(batch.column(1)[i].as_py())
        if held:
            yield from _tied(held, percent)

    parts = max(1, -(-buckets // 4))
    sent = rows.mapInArrow(thrifty(send), _PASSED).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(thrifty(receive), _PASSED.split(", ", 2)[2])


def _tied(blocks: list[bytes], percent: int):
    """Candidate pairs of one bucket: sets that share an n-gram, close in size,
    with enough after it; equal sets count once. The sets of a long list are tied as
    stars through sets of close size: in the order of size, two sets close enough have
    only such between them. What follows the n-gram bounds a partner's size: a set that
    can have no partner of its own size or more is tied to the largest of the others
    that it may link with, if there is one, as two such sets cannot link."""
    columns = [[], [], [], []]
    for block in blocks:
        raw = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        for column, kind, at in zip(columns, (np.uint64, np.uint64, np.int32, np.int32), (8, 8 + 8 * n, 8 + 16 * n, 8 + 20 * n), strict=True):
            column.append(np.frombuffer(raw, kind, n, at))
    gram, node = (np.concatenate(c) for c in columns[:2])
    size, step = (np.concatenate(c).astype(np.int64) for c in columns[2:])
    order = np.lexsort((step, node, size, gram))
    gram, node, size, step = gram[order], node[order], size[order], step[order]
    first = np.concatenate([[True], (gram[1:] != gram[:-1]) | (size[1:] != size[:-1]) | (node[1:] != node[:-1])])
    gram, node, size, step = gram[first], node[first], size[first], step[first]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    length = np.diff(np.append(starts, len(gram)))
    # widespread n-grams are what large groups of near copies share: a star does for them
    short = np.repeat((length <= LIST) & (gram[starts] < _HOT), length)
    ends = np.repeat(starts + length, length)
    left, right = [], []
    for apart in range(1, min(LIST, int(length.max(initial=0)))):
        a = np.flatnonzero(short & (np.arange(len(gram)) + apart < ends))
        if not len(a):
            break
        b = a + apart
        need = percent * (size[a] + size[b])
        rest = np.minimum(size[a] - step[a], size[b] - step[b])
        close = (100 * size[a] >= percent * size[b]) & ((100 + percent) * rest >= need)
        left.append(a[close])
        right.append(b[close])
    reach = (100 + percent) * (size - step) // percent - size  # a partner's size, at most
    upper = np.flatnonzero(~short & (reach >= size))
    lower = np.flatnonzero(~short & (reach < size))
    number = np.repeat(np.arange(len(starts)), length)
    chain = (number[upper[1:]] == number[upper[:-1]]) & (100 * size[upper[:-1]] >= percent * size[upper[1:]])
    place = np.searchsorted((number[upper] << 32) + size[upper], (number[lower] << 32) + reach[lower], "right") - 1
    below = upper[np.maximum(place, 0)] if len(upper) else lower
    tied = (place >= 0) & (number[below] == number[lower]) & (100 * size[below] >= percent * size[lower])
    one, two = np.concatenate([upper[:-1][chain], lower[tied]]), np.concatenate([upper[1:][chain], below[tied]])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    used = np.unique(np.concatenate([a, b, one, two]))
    if not len(used):
        return
    both, index = np.unique(np.stack([node[used], size[used].astype(np.uint64)], 1), axis=0, return_inverse=True)
    place = np.zeros(len(node), np.int64)
    place[used] = index.ravel()
    named = np.array(_named(both[:, 0], both[:, 1]))
    pairs = np.unique(np.sort(np.stack([place[a], place[b]], 1), axis=1), axis=0)
    roots = local_roots(len(both), place[one], place[two])
    other = np.flatnonzero(roots != np.arange(len(both)))
    for u, v, sure in ((pairs[:, 0], pairs[:, 1], False), (other, roots[other], True)):
        for at in range(0, len(u), 50_000):
            ends = named[u[at : at + 50_000]], named[v[at : at + 50_000]]
            k = len(ends[0])
            empty = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [empty, empty, empty, empty, pa.array(ends[0].tolist()), pa.array(ends[1].tolist()), pa.nulls(k, pa.binary()), pa.array([sure] * k)], _NAMES[2:]
            )


def _ties(passed: DataFrame, percent: int) -> DataFrame:
    """``u``, ``v``: candidate pairs whose histograms allow a link, and sure ties."""
    names = [F.least("node", "root").alias("u"), F.greatest("node", "root").alias("v")]
    pairs = passed.where("root IS NOT NULL AND NOT sure").select(*names).distinct()
    sketches = passed.where("root IS NULL AND n > 0").groupBy("node").agg(F.min("sketch").alias("sketch"))
    sketches = materialise(sketches, "sketches")
    for end in ("u", "v"):
        pairs = pairs.join(sketches.select(F.col("node").alias(end), F.col("sketch").alias(f"s_{end}")), end)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("u", "v", "s_u", "s_v")), strict=True)
            kept = [may_link(x, y, (int(u[16:], 16), int(v[16:], 16)), percent) for u, v, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    return pairs.mapInArrow(thrifty(run), "u string, v string").union(passed.where("sure").select(*names))


def _sized(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``members`` with size classes ``s``. Sets that link are at most one class
    apart; classes are a trifle wider than the greatest ratio, so that rounding
    cannot put two between."""
    width = math.log(100 / min(percent, 99)) * (1 + 1e-9)
    return members.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))


def _span(m):
    return F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))


def _chunks(sized: DataFrame) -> DataFrame:
    """``block``, ``s`` and the number ``m`` of chunks, of blocks of more than a chunk."""
    counts = materialise(sized.groupBy("block", "s").agg(F.count("*").alias("c")), "block-sizes")
    totals = counts.groupBy("block").agg(F.sum("c").alias("total")).where(F.col("total") > CHUNK)
    return materialise(counts.join(totals, "block").select("block", "s", F.ceil(F.col("c") / CHUNK).cast("int").alias("m")), "chunks")


def _dealt(sized: DataFrame, chunks: DataFrame) -> DataFrame:
    """``node`` and the groups ``g`` that a set is first compared in: its block, or
    for a large block its chunk; hubs in all chunks of sizes close to theirs."""

    def group(s, k):
        return F.xxhash64("block", s, k).alias("g")

    small = sized.join(chunks.select("block").distinct(), "block", "left_anti").select("node", F.xxhash64("block").alias("g"))
    large = sized.join(chunks, ["block", "s"])
    own = large.select("node", group("s", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")))
    order = Window.partitionBy("block", "s").orderBy(F.col("rare") / F.col("n"), "node")
    hubs = large.withColumn("r", F.row_number().over(order)).where(F.col("r") <= HUBS).select("node", "block", F.col("s").alias("of"))
    near = hubs.select("node", "block", F.explode(F.array(F.col("of") - 1, F.col("of"), F.col("of") + 1)).alias("s")).join(chunks, ["block", "s"])
    near = near.select("node", "block", "s", F.explode(_span(F.col("m"))).alias("k")).select("node", group("s", "k"))
    return small.union(own.union(near).distinct()).withColumn("part", F.lit(None).cast("string"))


def _dealt_again(sized: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame | None:
    """``node``, ``g`` and ``part`` of the sets of large blocks that are still more
    than one component: each set outside the largest one with all sets of close
    sizes, by chunks. Sets of one ``part`` need no comparison. None if there are none."""
    large = sized.join(chunks.select("block").distinct(), "block")
    large = large.join(labels, "node", "left").select("node", "block", "s", F.coalesce("label", "node").alias("part"))
    large = materialise(large, "block-parts")
    parts = large.groupBy("block", "part").agg(F.count("*").alias("c")).groupBy("block")
    parts = parts.agg(F.max(F.struct("c", "part")).alias("most"), F.count("*").alias("apart")).where("apart > 1")
    large = materialise(large.join(parts.select("block", F.col("most.part").alias("main")), "block").withColumn("other", F.col("part") != F.col("main")), "parts-apart")
    if large.isEmpty():
        return None
    cells = [F.ceil(F.count_if(x) / CHUNK).cast("int").alias(name) for x, name in ((F.col("other"), "o"), (~F.col("other"), "m"))]
    cells = materialise(large.groupBy("block", "s").agg(*cells), "cells")
    around = cells
    for step, name in ((1, "above"), (-1, "below")):
        around = around.join(cells.select("block", (F.col("s") - step).alias("s"), F.col("o").alias(f"o_{name}"), F.col("m").alias(f"m_{name}")), ["block", "s"], "left")
    around = around.na.fill(0)
    s, k, x_of = F.col("s"), F.col("k"), {0: "", 1: "_above", -1: "_below"}
    large = large.join(around, ["block", "s"]).withColumn("k", F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("o")).otherwise(F.col("m"))).cast("int"))

    def group(part, *of):
        return F.struct(F.xxhash64("block", *of).alias("g"), part.alias("part"))

    def others(step):  # among themselves
        if step == 0:
            return lambda x: group(F.col("part"), F.lit("others"), s, F.least(k, x), s, F.greatest(k, x))
        return lambda x: group(F.col("part"), F.lit("others"), *((s, k, s + 1, x) if step > 0 else (s - 1, x, s, k)))

    def with_main(step):
        return lambda x: group(F.lit("other"), F.lit("main"), s, k, s + step, x)

    def with_others(step):
        return lambda x: group(F.lit("main"), F.lit("main"), s + step, x, s, k)

    theirs = [F.transform(_span(F.col(f"{c}{x_of[d]}")), to(d)) for c, to in (("o", others), ("m", with_main)) for d in x_of]
    mains = [F.transform(_span(F.col(f"o{x_of[d]}")), with_others(d)) for d in x_of]
    found = large.select("node", F.explode(F.when(F.col("other"), F.concat(*theirs)).otherwise(F.concat(*mains))).alias("at"))
    return found.select("node", "at.g", "at.part")


def _runs(batches, keys: int):
    """Consecutive rows with equal first ``keys`` columns, as lists of tuples."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != last and held:
                yield held
                held = []
            last = row[:keys]
            held.append(row)
    if held:
        yield held


def _narrow(keys: np.ndarray) -> bytes:
    """The 48 bits after those that tell the fragment, six bytes each."""
    return ((keys << np.uint64(FRAGMENT_BITS)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _widened(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common; the sizes in the diagonal."""
    total = np.zeros((len(sets), len(sets)), np.float32)
    sizes = [len(s) for s in sets]
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(element) > 1
    number = np.cumsum(shared) - 1
    keep = shared[element]
    column, owner = number[element[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(shared.sum()), SLAB):
        a, b = np.searchsorted(column, [start, start + SLAB])
        slab = np.zeros((len(sets), SLAB), np.float32)
        slab[owner[a:b], column[a:b] - start] = 1
        total += slab @ slab.T
    total = total.astype(np.int32)
    np.fill_diagonal(total, sizes)
    return total


def possible(partial: np.ndarray, sizes: np.ndarray, percent: int, parts: np.ndarray | None = None) -> np.ndarray:
    """The upper half of a fragment's overlaps, without pairs that cannot link
    any more: were all the rest of the smaller one shared, it would not be
    enough, or their sizes differ too much. Leaving them out lowers their sum.
    Pairs of one of the ``parts`` are left out too."""
    rest = sizes - np.diag(partial)
    need = needed(np.maximum(sizes[:, None], sizes[None, :]), percent)
    good = partial + np.minimum(rest[:, None], rest[None, :]) >= need
    good &= np.minimum(sizes[:, None], sizes[None, :]) >= need
    if parts is not None:
        good &= parts[:, None] != parts[None, :]
    np.fill_diagonal(good, True)
    return np.triu(np.where(good, partial, 0)).astype(np.int32)


def _links(dealt: DataFrame, hot: Widespread, n: int, percent: int, parts: int) -> DataFrame:
    """``u``, ``v``: stars of the links in each group. ``dealt`` has ``node``,
    ``_text`` and the groups and parts ``gs`` of each set."""

    def segments(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                keys, bounds = shingle_sets(part.column(1), hot, n)
                out = []
                for i, (node, groups) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    own = keys[bounds[i] : bounds[i + 1]]
                    fragment = own >> np.uint64(64 - FRAGMENT_BITS)
                    for piece in np.split(np.arange(len(own)), np.flatnonzero(np.diff(fragment)) + 1):
                        blob = _narrow(own[piece])
                        out += [(g["g"], int(fragment[piece[0]]), node, len(own), g["part"], blob) for g in groups]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "f", "node", "n", "part", "segment"]
                    )

    def partial(batches):
        for rows in _runs(batches, 2):
            parts = None if rows[0][4] is None else np.unique([r[4] for r in rows], return_inverse=True)[1]
            if parts is not None and parts.max() == 0:
                continue
            matrix = possible(overlaps([_widened(r[5]) for r in rows]), np.array([r[3] for r in rows]), percent, parts)
            np.fill_diagonal(matrix, 0)
            used = np.flatnonzero(matrix.any(0) | matrix.any(1))
            if not len(used):
                continue
            matrix = matrix[np.ix_(used, used)]
            kind = next(k for k in (np.uint8, np.uint16, np.int32) if matrix.max() <= np.iinfo(k).max)
            blob = zstandard.ZstdCompressor(level=1).compress(matrix.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]], pa.int64()), pa.array([[rows[i][2] for i in used]], pa.list_(pa.string())), pa.array([blob], pa.binary())], ["g", "nodes", "matrix"]
            )

    def summed(batches):
        for rows in _runs(batches, 1):
            names = sorted({x for r in rows for x in r[1]})
            place = {x: i for i, x in enumerate(names)}
            total = np.zeros((len(names), len(names)), np.int64)
            for _, own, blob in rows:
                at = np.array([place[x] for x in own])
                raw = zstandard.ZstdDecompressor().decompress(blob)
                kind = {1: np.uint8, 2: np.uint16, 4: np.int32}[len(raw) // len(at) ** 2]
                total[np.ix_(at, at)] += np.frombuffer(raw, kind).reshape(len(at), len(at))
            size = np.array([int(x[16:], 16) for x in names])
            total = total + total.T  # a pair's counts may lie on either side: the order differs between fragments
            link = 100 * total >= percent * (size[:, None] + size[None, :] - total)
            a, b = np.nonzero(np.triu(link, 1))
            roots = local_roots(len(names), a, b)
            other = np.flatnonzero(roots != np.arange(len(names)))
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in other]), pa.array([names[i] for i in roots[other]])], ["u", "v"])

    cut_up = dealt.mapInArrow(thrifty(segments), "g long, f int, node string, n long, part string, segment binary")
    cut_up = cut_up.repartition(parts, "g", "f").sortWithinPartitions("g", "f")
    counted = cut_up.mapInArrow(thrifty(partial), "g long, nodes array<string>, matrix binary")
    counted = counted.repartition(parts, "g").sortWithinPartitions("g")
    return counted.mapInArrow(thrifty(summed), "u string, v string")


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``key``, ``hash`` (of the text), ``n`` (size of its
    set) and ``label``, equal for the rows of one component."""
    rows = _keyed(docs, key, text)
    spark = docs.sparkSession
    parts = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = widespread(rows, "_text", lambda column: shingle_sets(column, NOWHERE, n)[0], AT_LEAST, 4 * parts, parts, WIDE)
    passed = materialise(_candidates(rows, hot, n, percent, 4 * parts), "candidates")
    texts = passed.where("root IS NULL").select("key", "hash", "n", "rare", "node")
    blocks = materialise(components(_ties(passed, percent)), "blocks")
    # one text for each set of a block
    members = texts.join(blocks.select("node", F.col("label").alias("block")), "node")
    members = members.groupBy("node", "block", "n").agg(F.min("hash").alias("hash"), F.min("rare").alias("rare"))
    sized = _sized(materialise(members, "block-members"), percent)
    chunks = _chunks(sized)

    def compared(groups: DataFrame) -> DataFrame:
        groups = groups.groupBy("node").agg(F.collect_list(F.struct("g", "part")).alias("gs"))
        chosen = materialise(sized.select("node", "hash").join(groups, "node"), "dealt-sets")
        return materialise(_links(_one_text_each(rows, chosen), hot, n, percent, parts), "links")

    links = compared(_dealt(sized, chunks))
    labels = components(links)
    if not chunks.isEmpty():
        apart = _dealt_again(sized, chunks, labels)
        if apart is not None:
            labels = components(links.union(compared(apart)))
    found = texts.join(labels, "node", "left")
    own = F.concat_ws("/", F.lit("empty"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("hash"))
    return found.select("key", "hash", "n", F.when(F.col("n") == 0, own).otherwise(F.coalesce("label", "node")).alias("label"))


def _one_text_each(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``node``, ``_text``, ``gs`` of the chosen sets. Copies of a text share its
    hash: a first join finds them, one of each set is taken."""
    near = chosen.select(F.col("hash").alias("_h"), "node")
    picks = rows.select("_key", "_hash").join(broadcast_if_small(near.select("_h").distinct()), F.col("_hash") == F.col("_h"), "left_semi")
    picks = picks.groupBy("_hash").agg(F.min(F.coalesce("_key", F.lit((1 << 63) - 1))).alias("_k"))
    picks = materialise(picks.select(F.col("_hash").alias("_h"), "_k"), "picked-texts")
    texts = rows.withColumn("_place", F.coalesce("_key", F.lit((1 << 63) - 1)))
    texts = texts.join(broadcast_if_small(picks), (F.col("_hash") == F.col("_h")) & (F.col("_place") == F.col("_k"))).select("_hash", "_text")
    joined = texts.join(chosen, F.col("_hash") == F.col("hash")).select("node", "_text", "gs")
    return joined


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: the key, ``n_shingles`` and ``component_id``, the least
    key that links lead to, its own included.

    A null text has no words; a text without words has an empty set and links
    with nothing. Equal sets link. Null keys are not the least of anything; a
    component of null keys only has a null id. Repeated rows are one text each.
    An empty table gives no rows. Other columns are not read.
    """
    rows = materialise(linked(docs, key, text, **options), "linked")
    least = rows.groupBy("label").agg(F.min("key").alias("component_id"))
    out = rows.join(least, "label")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that link, over any number
    of steps, to one with a smaller key. Of rows with one key the one with the
    least text hash stays, and of rows equal in key and text one. Rows without
    words stay."""
    rows = materialise(linked(docs, key, text, **options), "linked").withColumn("place", F.coalesce("key", F.lit((1 << 63) - 1)))
    first = rows.groupBy("label").agg(F.min(F.struct("place", "hash")).alias("first"))
    drop = rows.where("n > 0").join(first, "label").where(F.struct("place", "hash") != F.col("first")).select("place", "hash").distinct()
    drop = broadcast_if_small(materialise(drop.select(F.col("place").alias("__p"), F.col("hash").alias("__h")), "dropped"))
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]  # whatever the names, none of them clashes
    place = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1))
    marked = docs.select(*own, place.alias("_place"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_hash"))
    same = (F.col("_place") == F.col("__p")) & (F.col("_hash") == F.col("__h"))
    kept = marked.join(drop, same, "left_anti")
    twice = rows.where("n > 0").groupBy("place", "hash").agg(F.count("*").alias("c")).where("c > 1")
    if not twice.isEmpty():  # rows equal in key and text: only those are dealt out
        twice = broadcast_if_small(materialise(twice.select(F.col("place").alias("__p"), F.col("hash").alias("__h")), "twice"))
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["_place", "_hash"]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
