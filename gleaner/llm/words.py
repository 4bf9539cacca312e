"""Words, word hashes and word n-grams of Arrow text columns, in NumPy.

A word is a run of bytes other than the space and 0x09-0x0D. A null text has no
words. Everything works on bounded slices of a batch, so memory follows the
longest text and not the number of rows.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
GATHER_BYTES = 1 << 20
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _trim() -> Callable:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda keep: 0


def give_back() -> None:
    """Hand to the system what Arrow and the C library keep of freed memory. Python
    workers outlive their tasks, and idle ones count on their executor too."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def thrifty(run: Callable) -> Callable:
    """A function of batches for ``mapInArrow`` that gives memory back at its end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(n: int, _cache: list = [np.zeros(0, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(_cache[0]) < n:
        _cache[0] = mixed(np.arange(max(n, 256), dtype=np.uint64)) | np.uint64(1)
    return _cache[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive zero-copy parts of ``batch`` with about ``limit`` bytes of
    ``text`` each; a longer text is a part of its own."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    if batch.nbytes > limit:
        give_back()


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words in each text."""
    data, offsets = text_bytes(column)
    word = _IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = word[starts]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Words:
    """``data``: the words of all texts, each followed by a space. Word ``w``
    is ``data[starts[w]:ends[w]]``; text ``d`` has the words from ``first[d]``
    to ``first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, start: int, end: int) -> bytes:
        """Words ``start`` to ``end`` of the slice, joined by one space."""
        return self.data[self.starts[start] : self.ends[end - 1]].tobytes() if end > start else b""

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: random odd weights by place, mixed with the length."""
        if len(self.starts) == 0:
            return np.zeros(0, np.uint64)
        spans = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(len(self.data), dtype=np.int64) - np.repeat(self.starts, spans)
        products = _weights(int(spans.max()))[place]
        products *= self.data.astype(np.uint64) + np.uint64(1)
        return mixed(np.add.reduceat(products, self.starts) ^ spans.astype(np.uint64))

    def documents(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``n``-word windows by first word, and whether a window
        stays in its text; the array is as long as the words."""
        h = self.hashes() if hashes is None else hashes
        out = np.zeros(len(h), np.uint64)
        for i in range(n):
            part = np.zeros_like(h)
            if i < len(h):
                part[: len(h) - i] = h[i:]
            out = out * np.uint64(0xD6E8FEB86659FD93) + part
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(h))
        return mixed(out), left >= n


def cut(column: pa.Array, lower: bool = False) -> Words:
    """Split the texts of ``column``; ``lower`` maps A-Z to a-z."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    word = _IS_WORD[data]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begins] = word[begins]
    number = np.cumsum(first, dtype=np.int64)
    total = np.concatenate([[0], number])
    per_text = total[offsets]
    kept = np.flatnonzero(word)
    place = np.arange(len(kept)) + number[kept] - 1
    out = np.full(len(kept) + int(total[-1]), 0x20, np.uint8)
    out[place] = data[kept]
    starts = place[first[kept]]
    ends = np.append(starts[1:], len(out)) - 1 if len(starts) else starts
    return Words(out, starts, ends, per_text)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling; the last
    ``width - 1`` places hold minima of what is left."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            np.minimum(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given byte ranges one after another, and their n + 1 offsets. The index
    of bytes is built for a part of the ranges at a time."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(offsets[-1]), data.dtype)
    at = 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GATHER_BYTES, "right")) - 1)
        index = np.arange(offsets[at], offsets[end])
        index += np.repeat(starts[at:end] - offsets[at:end], lengths[at:end])
        out[offsets[at] : offsets[end]] = data[index]
        at = end
    return out, offsets


def strings(data: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """A string (or binary) column over ``data``."""
    kind = kind or pa.string()
    return pa.Array.from_buffers(
        kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )
