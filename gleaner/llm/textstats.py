"""Statistics of whole texts, computed for many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, cut, mixed, text_bytes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (
    *BASE, "n_lines", "upper", "lower", "digits", "bangs", "pipes", "stops", "commas", "wide",
    "distinct", "stutter", "odd_ends", "short_words", "capitals", "longest", "squares",
)
WINDOW = 8
_BYTES = {
    "n_symbols": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": b"0123456789",
    "bangs": b"!",
    "pipes": b"|",
    "stops": b".?",
    "commas": b",;:",
    "wide": bytes(range(0xC2, 0xF5)),
    "word_chars": bytes(b for b in range(256) if b != 0x20 and b & 0xC0 != 0x80),
}
_ODD_ENDS = np.isin(np.arange(256), list(b"#*$%&|<>!=~^"))
_CAPITALS = np.isin(np.arange(256), list(range(65, 91)))


def _tables() -> dict[str, np.ndarray]:
    return {name: np.isin(np.arange(256), list(chars)) for name, chars in _BYTES.items()}


def repeated_windows(words: Words, hashes: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Words in ``n``-word windows that their text has twice or more."""
    grams, inside = words.grams(n, hashes)
    at = np.flatnonzero(inside)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        # windows of different texts differ by the text's number in their key
        keys = mixed(grams[at] ^ mixed(words.documents()[at].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    return np.cumsum(covered)[:-1] > 0


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text the lines with a word, and those of them equal to an earlier one."""
    total, repeated = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    data, offsets = text_bytes(column)
    whole = data.tobytes()
    for i in range(len(column)):
        text = whole[offsets[i] : offsets[i + 1]]
        rows = [row for row in text.split(b"\n") if row.strip(b" \t\r\x0b\x0c")]
        total[i] = len(rows)
        repeated[i] = len(rows) - len(set(rows))
    return total, repeated


def counts(column: pa.Array, full: bool = True) -> dict[str, np.ndarray]:
    """The ``BASE`` counts (with ``full`` all ``COUNTS``) of each text; a null
    text counts as empty."""
    words = cut(column)
    hashes = words.hashes()
    number = np.diff(words.first)
    bounds = np.append(words.starts, len(words.data))[words.first]

    def by_byte(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[bounds])

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.first])

    out = {"n_words": number}
    for name, table in _tables().items():
        if full or name in BASE or name in ("upper", "lower"):
            out[name] = by_byte(table[words.data])
    out["n_lines"], out["n_dup_lines"] = lines(column)
    out["n_repeat_words"] = by_word(repeated_windows(words, hashes).astype(np.int64))
    docs = words.documents()
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    out["stutter"] = by_word(again)
    if full:
        keys = mixed(hashes ^ mixed(docs.astype(np.uint64)))
        out["distinct"] = np.bincount(docs[np.unique(keys, return_index=True)[1]], minlength=len(column))
        size = words.ends - words.starts
        out["odd_ends"] = by_word(_ODD_ENDS[words.data[words.ends - 1]].astype(np.int64))
        out["short_words"] = by_word((size <= 3).astype(np.int64))
        out["capitals"] = by_word(_CAPITALS[words.data[words.starts]].astype(np.int64))
        out["squares"] = by_word(np.minimum(size, 1000) ** 2)
        longest = np.zeros(len(column), np.int64)
        if len(size):
            filled = number > 0
            longest[filled] = np.maximum.reduceat(size, words.first[:-1][filled])
        out["longest"] = longest
    return out
