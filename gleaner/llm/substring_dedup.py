"""Substring dedup by super-k-mers of words.

A window is ``WINDOW`` consecutive words. Its minimiser is the least of its
``GRAM``-word hashes. Consecutive windows with one minimiser travel as one packed
string to the minimiser's bucket. Equal windows have equal minimisers and so meet
in one bucket, where sorting brings them together and their words are compared.

Hot passages do not load one bucket: in the order of n-grams, frequent ones come
last, so a window has a frequent minimiser only if all of it lies in text that is
frequent. Such strings are equal wherever they occur, and a task sends one of each.
The buckets of a task's rows travel in one compressed block per bucket.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .hot import frequent, is_in
from .words import Words, cut, gathered, mixed, sliding_min, slices, strings, text_bytes

WINDOW, GRAM = 20, 4
_HOT = np.uint64(1 << 63)
_LEVEL = 3
SLICE_BYTES = 4 << 20


@dataclass
class Runs:
    """Super-k-mers of a slice: text, first word, number of windows, minimiser,
    and whether it is there more than once, as in text that repeats itself."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    twice: np.ndarray


def super_kmers(words: Words, hot: np.ndarray) -> Runs:
    """The runs of consecutive windows with one minimiser."""
    grams, _ = words.grams(GRAM)
    key = (grams >> np.uint64(1)) | np.where(is_in(grams, hot), _HOT, np.uint64(0))
    least = sliding_min(key, WINDOW - GRAM + 1)
    docs = words.documents()
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(grams))
    at = np.flatnonzero(left >= WINDOW)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none)
    least, docs = least[at], docs[at]
    begin = np.concatenate([[True], (least[1:] != least[:-1]) | (docs[1:] != docs[:-1])])
    first = np.flatnonzero(begin)
    windows = np.diff(np.append(first, len(at)))
    begin, spans = at[first], windows + WINDOW - GRAM
    found, _ = gathered(key, begin, spans)
    bounds = np.cumsum(spans) - spans
    times = np.add.reduceat((found == np.repeat(least[first], spans)).astype(np.int32), bounds)
    return Runs(docs[first], at[first] - words.first[docs[first]], windows, least[first], (times > 1).astype(np.int64))


def _order_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_place`` (the key, null as the largest), ``_text`` and ``_hash``
    of the text, which tells rows of one place apart and is 0 where there are
    none such."""
    own = F.col(f"`{key}`").cast("long")
    place = F.coalesce(own, F.lit((1 << 63) - 1))
    unique = docs.groupBy(place.alias("p")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    code = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.select(own.alias("_key"), place.alias("_place"), code.alias("_hash"), F.col(f"`{text}`").alias("_text"))


def _packed(words: Words, runs: Runs, place: np.ndarray, code: np.ndarray, buckets: int):
    """One row per bucket, a compressed block of the bucket's super-k-mers, and
    one row with the runs that need not travel: an equal string starts earlier
    in this very slice, so all their windows are repeats."""
    base = words.first[runs.text] + runs.start
    last = base + runs.windows + WINDOW - 2
    begin, length = words.starts[base], words.ends[last] - words.starts[base]
    data, offsets = gathered(words.data, begin, length)
    whole = data.tobytes()
    order = np.lexsort((runs.start, code[runs.text], place[runs.text]))
    seen: dict[bytes, tuple] = {}
    local = np.zeros(len(base), bool)
    bounds = offsets.tolist()
    for i in order.tolist():
        string = whole[bounds[i] : bounds[i + 1]]
        spot = (place[runs.text[i]], code[runs.text[i]], runs.start[i]) if string in seen else None
        if spot is None:
            seen[string] = (place[runs.text[i]], code[runs.text[i]], runs.start[i])
        elif spot != seen[string]:
            local[i] = True
    bucket = (mixed(runs.key) % np.uint64(buckets)).astype(np.int64)
    rest = np.flatnonzero(~local)
    rest = rest[np.argsort(bucket[rest], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[rest])) + 1
    press = zstandard.ZstdCompressor(level=_LEVEL)
    out = []
    for part in np.split(rest, cuts):
        if not len(part):
            continue
        text, text_offsets = gathered(data, offsets[part], length[part])
        wide = np.stack([place[runs.text[part]], code[runs.text[part]]]).astype(np.int64)
        narrow = np.stack([runs.start[part], runs.windows[part], np.diff(text_offsets), runs.twice[part]]).astype(np.int32)
        # 32 bits of the minimiser tell those of one bucket apart well enough: windows are compared by their words
        low = runs.key[part].astype(np.uint32)
        block = press.compress(np.int64(len(part)).tobytes() + wide.tobytes() + narrow.tobytes() + low.tobytes() + text.tobytes())
        out.append((int(bucket[part[0]]), block))
    own = np.flatnonzero(local)
    repeats = np.stack([place[runs.text[own]], code[runs.text[own]], runs.start[own], runs.windows[own]], axis=1).astype(np.int64)
    return out, _merged(repeats)


def _unpacked(block: bytes):
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    wide = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    narrow = np.frombuffer(raw, np.int32, 4 * n, 8 + 16 * n).reshape(4, n)
    keys = np.frombuffer(raw, np.uint32, n, 8 + 32 * n)
    return np.concatenate([wide, narrow]).T, keys, raw[8 + 36 * n :]


def _repeats(blocks: list[bytes]) -> np.ndarray:
    """``(place, hash, start, windows)`` of the windows of one bucket that have
    an equal window before them."""
    heads, keys, texts = zip(*map(_unpacked, blocks), strict=True)
    head, key, data = np.concatenate(heads), np.concatenate(keys), b"".join(texts)
    del heads, keys, texts
    offsets = np.concatenate([[0], np.cumsum(head[:, 4])])
    order = np.lexsort((head[:, 2], head[:, 1], head[:, 0], key))
    bounds = offsets.tolist()
    # equal strings first: all windows of the later ones are repeats
    strings: dict[bytes, int] = {}
    again, leaders = [], []
    for i in order.tolist():
        string = data[bounds[i] : bounds[i + 1]]
        leader = strings.setdefault(string, i)
        if leader == i:
            leaders.append(i)
        elif tuple(head[leader, :3]) != tuple(head[i, :3]):
            again.append(i)
    found = [head[again][:, :4]] if again else []
    # only minimisers that are there several times, in one string or in different ones, can have further equal windows
    leaders = np.array(leaders, np.int64)
    several = head[leaders, 5] > 0
    same = key[leaders][1:] == key[leaders][:-1]
    several[1:] |= same
    several[:-1] |= same
    leaders = leaders[several]
    if len(leaders):
        found.append(_equal_windows(data, offsets, head, key, leaders))
    return _merged(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Runs of windows that follow on one another as one row each."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    joins = np.zeros(len(rows), bool)
    joins[1:] = (rows[1:, :2] == rows[:-1, :2]).all(1) & (rows[1:, 2] == rows[:-1, 2] + rows[:-1, 3])
    first = np.flatnonzero(~joins)
    return np.concatenate([rows[first, :3], np.add.reduceat(rows[:, 3], first)[:, None]], axis=1) if len(rows) else rows


def _equal_windows(data: bytes, offsets, head, key, leaders) -> np.ndarray:
    text, bounds = gathered(np.frombuffer(data, np.uint8), offsets[leaders], head[leaders, 4])
    words = cut(pa.Array.from_buffers(pa.large_string(), len(leaders), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)]))
    windows = head[leaders, 3]
    row = np.repeat(np.arange(len(leaders)), windows)
    step = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    first = words.first[row] + step
    gram = words.grams(WINDOW)[0][first]
    own = head[leaders][row]
    order = np.lexsort((own[:, 2] + step, own[:, 1], own[:, 0], gram, key[leaders][row]))
    row, step, first, gram, own = row[order], step[order], first[order], gram[order], own[order]
    near = gram[1:] == gram[:-1]
    # equal hashes: the words themselves decide
    begin, end = words.starts[first], words.ends[first + WINDOW - 1]
    at = np.flatnonzero(near) + 1
    repeated = np.zeros(len(first), bool)
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        part = part[end[part] - begin[part] == end[part - 1] - begin[part - 1]]
        if len(part):
            a, bound = gathered(words.data, begin[part], end[part] - begin[part])
            b, _ = gathered(words.data, begin[part - 1], end[part] - begin[part])
            repeated[part] = np.add.reduceat((a != b).astype(np.int64), bound[:-1]) == 0
    # a hash that two different windows share (hardly ever): compare all windows of that hash by their words
    for i in at[~repeated[at]].tolist():
        lo = int(np.searchsorted(np.flatnonzero(~np.concatenate([[False], near])), i, "right")) - 1
        lo = int(np.flatnonzero(~np.concatenate([[False], near]))[lo])
        string = words.data[begin[i] : end[i]].tobytes()
        repeated[i] = any(words.data[begin[j] : end[j]].tobytes() == string for j in range(lo, i))
    # the same place of the same text twice (equal rows) is one occurrence
    spot = np.stack([own[:, 0], own[:, 1], own[:, 2] + step], axis=1)
    twin = np.concatenate([[False], (spot[1:] == spot[:-1]).all(1) & near])
    for i in np.flatnonzero(twin).tolist():
        repeated[i] = repeated[i - 1]
    hit = np.flatnonzero(repeated)
    return np.stack([own[hit, 0], own[hit, 1], own[hit, 2] + step[hit], np.ones(len(hit), np.int64)], axis=1)


def _rows(repeats: np.ndarray, buckets=None, blocks=None) -> pa.RecordBatch:
    """Rows ``(bucket, block, place, hash, start, windows)``."""
    n, m = len(blocks or ()), len(repeats)
    empty = pa.nulls(n, pa.int64())
    spread = (mixed(repeats[:, 0].astype(np.uint64)) & np.uint64(0x3FFFFFFF)).astype(np.int64)
    columns = [
        pa.concat_arrays([pa.array(buckets or [], pa.int64()), pa.array(spread, pa.int64())]),
        pa.array([*(blocks or ()), *[None] * m], pa.binary()),
        *(pa.concat_arrays([empty, pa.array(repeats[:, i], pa.int64())]) for i in range(4)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "place", "hash", "start", "windows"])


_SCHEMA = "bucket long, block binary, place long, hash long, start long, windows long"


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Windows whose words also start earlier, as rows of ``place`` (the key, null
    as the largest), ``hash`` of the text, ``start`` (word) and ``windows``, how
    many from there on. ``buckets`` defaults to four times the scan's tasks or
    the shuffle partitions, whichever is more: a bucket holds a task's fourth.
    """
    return _repeated_windows(_order_key(docs, key, text), buckets)


def _repeated_windows(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    spark = rows.sparkSession
    parts = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = buckets or 4 * parts

    def grams(column):
        words = cut(column)
        found, inside = words.grams(GRAM)
        return found[inside]

    hot = frequent(rows, "_text", grams, 1 / (2 * buckets))

    def send(batches):
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                words = cut(part.column(3))
                runs = super_kmers(words, hot)
                place = part.column(1).to_numpy(zero_copy_only=False)
                code = part.column(2).to_numpy(zero_copy_only=False)
                if len(runs.text):
                    out, repeats = _packed(words, runs, place, code, buckets)
                    yield _rows(repeats, [b for b, _ in out], [x for _, x in out])

    def receive(batches):
        held: list[bytes] = []
        bucket = None
        for batch in batches:
            whole = batch.column(1)
            local = whole.is_null().to_numpy(zero_copy_only=False)
            if local.any():
                own = batch.filter(pa.array(local))
                yield pa.RecordBatch.from_arrays(own.columns[2:], ["place", "hash", "start", "windows"])
            for i in np.flatnonzero(~local).tolist():
                number = batch.column(0)[i].as_py()
                if number != bucket and held:
                    yield from _found(_repeats(held))
                    held = []
                bucket = number
                held.append(whole[i].as_py())
        if held:
            yield from _found(_repeats(held))

    sent = rows.mapInArrow(send, _SCHEMA).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(receive, "place long, hash long, start long, windows long")


def _found(repeats: np.ndarray):
    if len(repeats):
        yield pa.RecordBatch.from_arrays([pa.array(repeats[:, i]) for i in range(4)], ["place", "hash", "start", "windows"])


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key``, ``_packed`` (the compressed text) and ``_spans``, the repeated
    windows of each row as ``start`` and ``windows``."""
    rows = _order_key(docs, key, text)
    found = materialise(_repeated_windows(rows), "repeated-windows")
    spans = found.groupBy("place", "hash").agg(F.collect_list(F.struct("start", "windows")).alias("_spans"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=_LEVEL)
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            whole = memoryview(data)
            texts = [press.compress(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], ["a", "b", "c", "d"])

    packed = rows.mapInArrow(pack, "_key long, _place long, _hash long, _packed binary")
    return packed.join(spans, (F.col("_place") == F.col("place")) & (F.col("_hash") == F.col("hash")), "left").select("_key", "_packed", "_spans")


def _unpack(batch: pa.RecordBatch):
    """The batch with its texts, in parts of bounded size."""
    press, start = zstandard.ZstdDecompressor(), 0
    packed = batch.column(1).to_pylist()
    while start < batch.num_rows:
        texts, size = [], 0
        while start + len(texts) < batch.num_rows and size < SLICE_BYTES:
            texts.append(press.decompress(packed[start + len(texts)]))
            size += len(texts[-1])
        part = batch.slice(start, len(texts))
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        column = strings(np.frombuffer(b"".join(texts), np.uint8), bounds)
        yield pa.RecordBatch.from_arrays([part.column(0), column, part.column(2)], ["_key", "_text", "_spans"])
        start += len(texts)


def _kept(part: pa.RecordBatch):
    """Per text its words, a mask of the kept ones, and the kept text."""
    words = cut(part.column(1))
    change = np.zeros(len(words.starts) + 1, np.int64)
    spans = part.column(2)
    number = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    start = words.first[number] + flat.field("start").to_numpy(zero_copy_only=False)
    end = start + flat.field("windows").to_numpy(zero_copy_only=False) + WINDOW - 1
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change)[:-1] == 0
    at = np.flatnonzero(kept)
    data, offsets = gathered(words.data, words.starts[at], words.ends[at] - words.starts[at] + 1)
    number = np.concatenate([[0], np.cumsum(kept)])[words.first]
    bounds = offsets[number]
    whole = data.tobytes()
    texts = [whole[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.diff(words.first), np.diff(words.first) - np.diff(number), texts


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: the key, ``n_words``, ``n_removed`` and ``kept_text``,
    the words left, joined by one space.

    A word goes if a window over it also starts earlier: in a smaller key, or
    earlier in the same text; windows are judged on the input. Null keys count
    as the largest; rows with one key are ordered by their texts' hash, and rows
    equal in key and text are one occurrence and give equal results. A null
    text has no words. An empty table gives no rows. Other columns are not read.
    """
    return _finished(docs, key, text, "kept_text string", lambda texts: pa.array([t.decode() for t in texts], pa.string()))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``deduplicated`` with ``kept_sha256`` in place of the text."""
    return _finished(docs, key, text, "kept_sha256 string", lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))


def _finished(docs, key, text, last, make):
    rows = removals(docs, key, text)

    def run(batches):
        for batch in batches:
            for part in _unpack(batch):
                words, removed, texts = _kept(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), make(texts)], ["k", "w", "r", "t"])

    return rows.mapInArrow(run, f"_key long, n_words long, n_removed long, {last}").withColumnRenamed("_key", key)
