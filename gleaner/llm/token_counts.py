"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-level BPE the encoding of a piece's prefix ends with exactly one token
``t`` such that the encoding of what lies before ends with a token ``s`` and
``(s, t)`` encodes as itself. So the counts of all prefixes follow from left to
right, each from one earlier prefix, and no prefix is encoded again. Pieces
repeat, so their count differences are memoised; a text's table is the
concatenation of its pieces' differences.
"""

from __future__ import annotations

import array
import functools
import itertools
import operator
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .bytelevel import Adjacency, Recent, newer_characters, read_json, split_pieces

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 300_000


@functools.cache
def _newer_characters():
    rule = ByteLevel(add_prefix_space=False)
    return newer_characters(lambda c: any(len(rule.pre_tokenize_str(x + c)) == 1 for x in "a1"))


class PrefixCounter:
    """Counts for the tokenizer file at ``path``."""

    def __init__(self, path: str):
        self.tokens, merges, special = read_json(path)
        # tokens as a tree by their bytes from the last to the first; at -1 the token's number
        self._endings: dict = {}
        for token, number in self.tokens.items():
            node = self._endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = number
        self._pattern = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        parts = {made: (a, b, rank) for (a, b), (rank, made) in merges.items()}
        self._follows = Adjacency(parts.get, lambda x, y: merges.get((x, y), (None,))[0])
        self._deltas = Recent(self._piece_deltas, CACHED)

    def piece_counts(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of one piece, by number of bytes."""
        last, counts = [-1], [0]
        root, known, follows = self._endings, self._follows.known, self._follows
        for end in range(len(piece)):
            node, start = root, end
            while True:  # tokens that end here, from the shortest
                node = node[piece[start]]
                token = node.get(-1)
                if token is not None:
                    left = last[start]
                    good = known.get(left << 32 | token)
                    if good or good is None and follows(left, token):
                        last.append(token)
                        counts.append(counts[start] + 1)
                        break
                start -= 1
        return counts

    def _piece_deltas(self, piece: str) -> bytes:
        data = piece.encode()
        counts = self.piece_counts(data)
        if len(data) != len(piece):
            ends = itertools.accumulate(len(c.encode()) for c in piece)
            counts = [0, *(counts[e] for e in ends)]
        if len(piece) == 3 and piece[0] == "'" and piece[1] in "rvl":  # 're, 've, 'll: their first two characters are two pieces
            counts[2] = 1 + self.piece_counts(data[1:2])[-1]
        return array.array("h", map(operator.sub, counts[1:], counts)).tobytes()

    def _plain(self, text: str) -> np.ndarray:
        pieces = split_pieces(text, self._pattern, _newer_characters)
        deltas = self._deltas
        if isinstance(pieces, list):
            out = np.frombuffer(b"".join([deltas[p] for p in pieces]), np.int16)
        else:
            parts = []
            for group in iter(lambda: [deltas[p] for p in itertools.islice(pieces, 100_000)], []):
                parts.append(b"".join(group))
            out = np.frombuffer(b"".join(parts), np.int16)
        return out

    def deltas(self, text: str) -> np.ndarray:
        """By how much each further character changes the token count (int16)."""
        if self._special is not None and (found := list(self._special.finditer(text))):
            return self._with_special(text, found)
        out = self._plain(text)
        return self._runs(text, out) if _SPACES.search(text) else out

    def _runs(self, text: str, out: np.ndarray) -> np.ndarray:
        """A prefix that ends inside a run of white space has the run as one
        piece, while the whole text gives its last character to what follows."""
        fixed = None
        for m in _RUNS.finditer(text):
            start, end = m.span()
            if end == len(text):
                continue
            if fixed is None:
                fixed = out.copy()
            counts = self.piece_counts(text[start:end].encode())
            ends = list(itertools.accumulate(len(c.encode()) for c in text[start:end]))
            extra = counts[ends[-1]] - int(fixed[start:end].sum())
            fixed[end - 1] += extra
            fixed[end] -= extra
        return out if fixed is None else fixed

    def _with_special(self, text: str, found) -> np.ndarray:
        parts, at = [], 0
        for m in found:
            before = text[at : m.start()]
            own = self.deltas(before)
            total = int(own.sum(dtype=np.int64))
            counts = [int(self.deltas(before + m.group()[:k]).sum(dtype=np.int64)) - total for k in range(1, len(m.group()))]
            parts += [own, np.diff(np.array([0, *counts, 1])).astype(np.int16)]
            at = m.end()
        rest = text[at:]
        return np.concatenate([*parts, self.deltas(rest) if rest else np.zeros(0, np.int16)])


_SPACES, _RUNS = re.compile(r"\s\s"), regex.compile(r"\s{2,}")


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(deltas: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens. Counts
    are not monotone: a further character can merge tokens."""
    within = np.flatnonzero(np.cumsum(deltas, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_tables(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_bytes``, ``n_tokens`` and
    ``prefix_deltas``, the little-endian int16 differences of the token counts of
    all prefixes by characters.

    A null text counts as empty (0 tokens, empty table); a null or repeated key
    is passed on row by row; an empty table gives no rows. Other columns of
    ``docs`` are not read, so their names do not matter. ``path`` is a tokenizer
    file that every executor has.
    """
    return _mapped(docs, path, key, text, None, True)


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``prefix_tables`` reduced where it is computed: the key, ``n_bytes``,
    ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and
    ``chars_in_limit``, the longest prefix within the limit."""
    return _mapped(docs, path, key, text, limit, False)


def answer(tables: DataFrame, budgets: list[int], key: str = "doc_id") -> DataFrame:
    """Truncation questions from stored ``prefix_tables``, without encoding: a
    row per row and budget with ``chars``, the longest prefix within it."""
    rows = tables.select(F.col(key).alias("_key"), "prefix_deltas")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                deltas = np.frombuffer(batch.column(1)[i].as_py() or b"", np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1).take(pa.array([0] * len(budgets))),
                        pa.array(budgets, pa.int64()),
                        pa.array([longest_prefix(deltas, b) for b in budgets], pa.int64()),
                    ],
                    ["_key", "budget", "chars"],
                )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, budget long, chars long").withColumnRenamed("_key", key)


def _mapped(docs, path, key, text, limit, store):
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    last = "prefix_deltas binary" if store else "over_limit boolean, chars_in_limit long"

    def run(batches):
        count = counter(path)
        for batch in batches:
            n_bytes, n_tokens, extra = [], [], []
            for value in batch.column(1):
                whole = value.as_py() or ""
                deltas = count.deltas(whole)
                n = int(deltas.sum(dtype=np.int64))
                n_bytes.append(value.as_buffer().size if whole else 0)
                n_tokens.append(n)
                extra.append(deltas.tobytes() if store else len(whole) if n <= limit else longest_prefix(deltas, limit))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            if store:
                columns.append(pa.array(extra, pa.binary()))
            else:
                columns += [pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    out = rows.mapInArrow(run, f"_key {kind}, n_bytes long, n_tokens long, {last}")
    return out.withColumnRenamed("_key", key)
