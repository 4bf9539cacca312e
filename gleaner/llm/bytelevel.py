"""Vocabularies of byte-level tokenizers and bounded caches."""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

import regex

LONG_TEXT = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.cache
def read_json(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], tuple[str, ...]]:
    """Tokens by bytes, merges ``(left, right) -> (rank, token)`` and the
    special strings of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    alphabet = byte_alphabet()
    names = spec["model"]["vocab"]
    special = tuple(x["content"] for x in spec.get("added_tokens", ()))
    tokens = {bytes(alphabet[c] for c in name): i for name, i in names.items() if name not in special}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[names[left], names[right]] = (rank, names[left + right])
    return tokens, merges, special


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a ``.tiktoken`` file."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Adjacency:
    """Whether two tokens, put together, encode as themselves.

    ``parts(t)`` gives the two tokens that ``t`` is merged from and the rank of
    that merge (None for a byte), ``rank(x, y)`` the rank of merging two tokens
    (None if they do not merge). The pair stands unless a merge across it comes
    before its parts are taken up on their own sides; of equal ranks the left
    merge comes first.
    """

    def __init__(self, parts: Callable, rank: Callable, size: int = 1_500_000):
        self._parts, self._rank, self._size = parts, rank, size
        self._ends: tuple[dict, dict] = ({}, {})
        self.known: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the left (0) or right (1) end while the token is merged,
        each part with the rank of the merge that takes it up."""
        spine = self._ends[side].get(token)
        if spine is None:
            spine, part, taken = [], token, 1 << 60
            while True:
                spine.append((part, taken))
                made = self._parts(part)
                if made is None:
                    break
                part, taken = made[side], made[2]
            self._ends[side][token] = spine
        return spine

    def __call__(self, left: int, right: int) -> bool:
        """The answer, kept in ``known[left << 32 | right]``. A left of -1 stands
        for the start of a piece."""
        good = left < 0 or self._stands(self._spine(left, 1), self._spine(right, 0))
        if len(self.known) > self._size:
            self.known.clear()
        self.known[left << 32 | right] = good
        return good

    def _stands(self, ends: list, starts: list) -> bool:
        for x, x_taken in ends:
            for y, y_taken in starts:
                rank = self._rank(x, y)
                if rank is not None and rank < x_taken and rank <= y_taken:
                    return False
        return True


class Recent(dict):
    """A memo of ``make(key)`` for the keys seen lately: once ``size`` keys are
    held, the older half is dropped; keys of more than ``longest`` characters are
    not kept. Look up with ``self[key]``."""

    def __init__(self, make, size: int = 200_000, longest: int | None = None):
        super().__init__()
        self._make, self._size, self._longest, self._old = make, size, longest, {}

    def __missing__(self, key):
        if self._longest is not None and len(key) > self._longest:
            return self._make(key)
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self.keep(key, value)
        return value

    def has(self, key) -> bool:
        return key in self or key in self._old

    def keep(self, key, value) -> None:
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value


def newer_characters(known: Callable[[str], bool]) -> tuple[re.Pattern | None, dict[int, str]]:
    """Characters that the regex library calls letters or numbers and a tokenizer
    library, with older tables, does not: a pattern that finds them and a
    stand-in for each. ``known`` asks the tokenizer library."""
    everything = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    odd = [c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn" and not known(c)]
    if not odd:
        return None, {}
    spans = [[odd[0], odd[0]]]
    for c in odd[1:]:
        if ord(c) == ord(spans[-1][1]) + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{a}-{b}" for a, b in spans) + "]"), {ord(c): "\uffff" for c in odd}


def split_pieces(text: str, pattern: regex.Pattern, newer: Callable) -> Iterable[str]:
    """The pieces of ``text``; a list, or for long texts an iterator."""
    odd, table = (None, {}) if text.isascii() else newer()
    if odd is not None and odd.search(text):
        return (text[m.start() : m.end()] for m in pattern.finditer(text.translate(table)))
    if len(text) > LONG_TEXT:
        return (m.group() for m in pattern.finditer(text))
    return pattern.findall(text)
