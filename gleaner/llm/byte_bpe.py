"""Byte-level BPE: encoding by a finite-state transducer, streaming decoding.

The merges of a ``.tiktoken`` file are compiled lazily. The transducer reads a
piece byte by byte. A state is the bytes read since the last token that is
certain, with that token; tokens come out once every continuation agrees on
them, after a lookahead bounded by the longest token. Transitions are worked out
when they are first taken and kept, so most bytes cost one look-up.

Decoding joins token bytes and runs a UTF-8 state machine over them, so that
text comes out as soon as its characters are complete, in chunks of any size.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import LONG_TEXT, Adjacency, Recent, newer_characters, read_ranks, split_pieces
from .lanes import Lanes
from .words import slices, thrifty

STATES = 20_000  # held for pieces read by themselves, before the transducer starts anew
CACHED, LONG_PIECE = 250_000, 64  # pieces that are kept, and up to how many characters
SHORT, PART = 96, 4096  # bytes of a piece read with others, and of a long one that are read in one go
DECODED = 1 << 16
LANES = 20_000  # pieces read at a time
TEXTS = 2 << 20  # bytes of texts encoded at a time
_TOKEN = (1 << 32) - 1


def _trie(tokens: Iterable[tuple[bytes, int]]) -> tuple[dict[int, int], list[int]]:
    """Nodes by ``node << 8 | byte``, and the token that ends at each node or -1."""
    below, ending = {}, [-1]
    for data, rank in tokens:
        node = 0
        for byte in data:
            new = below.get(node << 8 | byte)
            if new is None:
                new = below[node << 8 | byte] = len(ending)
                ending.append(-1)
            node = new
        ending[node] = rank
    return below, ending


class Transducer:
    """The merges of ``ranks`` as a lazily determinised transducer.

    A numbered state is the last certain token (-1 at a piece's start) and the
    bytes after it. ``links`` has for each beginning of these bytes where its last
    token starts, and that token, so that the tokens of all beginnings are one
    tree; ``open`` are the beginnings after which a token can go on, with the node
    of the vocabulary's trie that the bytes since lead to. The tokens on the tree's
    path to all open beginnings are certain. ``STATES`` are held at most.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self._ranks = ranks
        names = self._names = {i: b for b, i in ranks.items()}
        self.trie, self.ending = self._trie, self._ending = _trie(ranks.items())
        self.adjacent = self._adjacent = Adjacency(functools.cache(self._parts), lambda x, y: ranks.get(names[x] + names[y]), 300_000)
        self.clear()

    def clear(self) -> None:
        """Forget all states."""
        self._states: list[tuple[int, bytes, tuple, tuple]] = [(-1, b"", (0,), ((0, 0),))]
        self._number = {b"": 0}
        self._moves: dict[int, int] = {}  # by state << 8 | byte: the next state << 1 | whether tokens come out
        self._out: dict[int, tuple[int, ...]] = {}
        self._ends: dict[int, tuple[int, ...]] = {}

    def _parts(self, token: int) -> tuple[int, int, int] | None:
        """The last merge that makes the token: by ranks below its own, the left
        one of equals first, its bytes come down to two parts."""
        data, ranks = self._names[token], self._ranks
        if len(data) == 1:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]], token

    def _path(self, links: tuple, end: int) -> tuple[int, ...]:
        """The tokens of the beginning with ``end`` bytes."""
        out = []
        while end:
            out.append(links[end] & _TOKEN)
            end = links[end] >> 32
        return tuple(out[::-1])

    def _move(self, state: int, byte: int) -> int:
        token, data, links, starts = self._states[state]
        trie, ending, known = self._trie, self._ending, self._adjacent.known
        data += _BYTES[byte]
        still, link = [], -1
        for start, node in reversed(starts):  # from the shortest token that could end here
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            still.append((start, node))
            if link < 0 and (last := ending[node]) >= 0:
                pair = (links[start] & _TOKEN if start else token) << 32 | last
                good = known.get(pair)
                if good or good is None and self._adjacent(pair >> 32, last):
                    link = start << 32 | last
        links += (link,)
        still = [(len(data), 0), *still]
        sure = still[-1][0]
        for at, _ in still:  # the deepest beginning that all open ones go through
            while at != sure:
                if at > sure:
                    at = links[at] >> 32
                else:
                    sure = links[sure] >> 32
        out = ()
        if sure:
            out = self._path(links, sure)
            token, data = out[-1], data[sure:]
            links = (0, *[x - (sure << 32) if x >> 32 >= sure else -1 for x in links[sure + 1 :]])
            still = [(at - sure, node) for at, node in still]
        key = data + token.to_bytes(4, "little", signed=True)
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append((token, data, links, tuple(still[::-1])))
        step = self._moves[state << 8 | byte] = number << 1 | bool(out)
        if out:
            self._out[state << 8 | byte] = out
        return step

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece; a long one is read in parts, as states may be
        forgotten between them."""
        state, out = 0, []
        for at in range(0, len(piece), PART):
            if len(self._states) > STATES:
                kept = self._states[state]
                self.clear()
                if state:
                    self._number[kept[1] + kept[0].to_bytes(4, "little", signed=True)] = state = 1
                    self._states.append(kept)
            state = self._read(piece[at : at + PART] if len(piece) > PART else piece, state, out)
        ends = self._ends.get(state)
        if ends is None:
            _, data, links, _ = self._states[state]
            ends = self._ends[state] = self._path(links, len(data))
        out += ends
        return out

    def _read(self, piece: bytes, state: int, out: list[int]) -> int:
        moves = self._moves
        for byte in piece:
            key = state << 8 | byte
            step = moves.get(key) or self._move(state, byte)
            state = step >> 1
            if step & 1:
                out += self._out[key]
        return state


_BYTES = [bytes([b]) for b in range(256)]


# UTF-8 automaton: lead bytes give the state, continuation bytes lead back to 0.
# A state is the number of bytes to come and the range the next one must be in.
def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    left, low, high = state
    if left:
        return (left - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return state
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


_FOLLOW = np.array([1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0 if b < 0x80 else -1 for b in range(256)], np.int8)
_SECOND_LOW = np.full(256, 0x80, np.uint8)
_SECOND_HIGH = np.full(256, 0xBF, np.uint8)
_SECOND_LOW[[0xE0, 0xF0]], _SECOND_HIGH[[0xED, 0xF4]] = (0xA0, 0x90), (0x9F, 0x8F)


def whole_characters(data: bytes) -> int:
    """How many bytes of ``data`` the automaton turns into whole characters before
    a character that is incomplete at the end; -1 if a byte cannot be UTF-8. All
    bytes are stepped at once: a lead byte tells which bytes belong to it."""
    values = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((values & 0xC0) != 0x80)
    need = _FOLLOW[values[lead]].astype(np.int64)
    if not len(lead):
        return -1
    size = np.diff(np.append(lead, len(values))) - 1
    if lead[0] or (need < 0).any() or (size[:-1] != need[:-1]).any() or size[-1] > need[-1]:
        return -1
    wide = lead[(need > 0) & (size > 0)]
    second = values[wide + 1]
    if ((second < _SECOND_LOW[values[wide]]) | (second > _SECOND_HIGH[values[wide]])).any():
        return -1
    return len(data) if size[-1] == need[-1] else int(lead[-1])


class StreamDecoder:
    """Turns token ids into text as they come. Bytes that cannot be UTF-8 give
    U+FFFD; the bytes of a character still incomplete are held back."""

    START = (0, 0x80, 0xBF)

    def __init__(self, names: dict[int, bytes]):
        self._names, self._state, self._held = names, self.START, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self._names.__getitem__, ids))
        if not self._held and data.isascii():
            return data.decode()
        whole = self._held + data
        size = whole_characters(whole)
        if size < 0:
            return "".join(map(self._byte, data))
        self._held, self._state = b"", self.START
        for byte in whole[size:]:
            self._byte(byte)
        return whole[:size].decode()

    def _byte(self, byte: int) -> str:
        state = _utf8_step(self._state, byte)
        if state is None:
            broken = "\ufffd" if self._held else ""
            held, self._held, self._state = self._held, b"", self.START
            return broken + self._byte(byte) if held else "\ufffd"
        self._held += _BYTES[byte]
        self._state = state
        if state[0]:
            return ""
        text, self._held, self._state = self._held.decode(), b"", self.START
        return text

    def finish(self) -> str:
        rest, self._held, self._state = "\ufffd" if self._held else "", b"", self.START
        return rest


def _letters_of(ranks: dict[bytes, int], pattern: str):
    """Whether tiktoken calls a character a letter or number: then an
    apostrophe after it starts a piece of its own."""
    own = tiktoken.Encoding("characters", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    suffix = ranks.get(b"'re")
    return lambda c: own.encode_ordinary(c + "'re")[-1] == suffix


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of ASCII characters only, in the faster library;
    None if it uses more than the two classes of characters."""
    plain = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", lambda m: _ascii_class(m.group()), pattern)
    if r"\p" in plain:
        return None
    found = re.compile(plain, re.ASCII)
    return found if found.groups == 0 else None


def _ascii_class(part: str) -> str:
    if part.startswith("["):
        return part.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    return {"L": "[A-Za-z]", "N": "[0-9]"}[part[3]]


class Codec:
    """Encodes and decodes whole texts with the file at ``path``."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.names = {i: b for b, i in ranks.items()}
        self._pattern = regex.compile(pattern)
        self._ascii = ascii_pattern(pattern)
        self._transducer = Transducer(ranks)
        self._lanes = Lanes(self._transducer.trie, self._transducer.ending, self._transducer.adjacent)
        self._newer = functools.cache(lambda: newer_characters(_letters_of(ranks, pattern)))
        self.clear()

    def clear(self) -> None:
        """Give back what was learned from texts."""
        self._transducer.clear()
        self._lanes.clear()
        self._ids = Recent(self._alone, CACHED, LONG_PIECE)

    def _alone(self, piece: str) -> bytes:
        ids = self._transducer.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> Iterable[str]:
        if self._ascii is not None and len(text) <= LONG_TEXT and text.isascii():
            return self._ascii.findall(text)
        return split_pieces(text, self._pattern, self._newer)

    def _learn(self, pieces: Iterable[str]) -> None:
        """Read the pieces that are not known yet together."""
        fresh = [p for p in pieces if len(p) <= LONG_PIECE and not self._ids.has(p)]
        data = [p.encode() for p in fresh]
        short = [i for i, d in enumerate(data) if len(d) <= SHORT]
        for at in range(0, len(short), LANES):
            part = short[at : at + LANES]
            tokens, offsets, read = self._lanes.encode([data[i] for i in part])
            whole, ends = tokens.astype("<u4").tobytes(), (4 * offsets).tolist()
            for i, a, b, done in zip(part, ends, ends[1:], read.tolist(), strict=False):
                if done:
                    self._ids.keep(fresh[i], whole[a:b])

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts should be few megabytes together, one long
        text is read in parts."""
        ids, out = self._ids.__getitem__, []
        split = [self._pieces(text) for text in texts]
        lists = [p for p in split if isinstance(p, list)]
        self._learn(set().union(*lists))
        for pieces in split:
            if isinstance(pieces, list):
                out.append(np.frombuffer(b"".join(map(ids, pieces)), "<u4"))
                continue
            parts = []
            for group in iter(lambda: list(itertools.islice(pieces, 100_000)), []):  # noqa: B023
                self._learn(set(group))
                parts.append(b"".join(map(ids, group)))
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def decode(self, ids: np.ndarray, chunk: int = DECODED) -> Iterator[str]:
        """Text in chunks of ``chunk`` tokens."""
        decoder = StreamDecoder(self.names)
        for start in range(0, len(ids), chunk):
            yield decoder.feed(ids[start : start + chunk].tolist())
        yield decoder.finish()


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _with_codec(docs: DataFrame, path: str, pattern: str, key: str, text: str, make, schema: str) -> DataFrame:
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        own = codec(path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, "_text", TEXTS):
                    made = list(make(own, part.column(1).to_pylist()))
                    columns = [part.column(0), *(pa.array(c) for c in zip(*made, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])
        finally:  # the worker goes on to other tasks
            own.clear()

    return rows.mapInArrow(thrifty(run), f"_key {kind}, {schema}").withColumnRenamed("_key", key)


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``n_tokens`` and ``ids``, the tokens as little-endian unsigned
    32-bit integers.

    A null text counts as empty (no tokens). Null and repeated keys are passed on
    row by row, other columns of ``docs`` are not read, and an empty table gives
    no rows. A text is encoded whole, and so is a piece of any length; besides the
    text and its ids a task holds at most ``STATES`` states and ``CACHED`` pieces
    (twice), which it gives back at its end. ``path`` must be readable on every executor.
    """

    def make(own: Codec, values):
        return [(len(ids), ids.tobytes()) for ids in own.encode_all([v or "" for v in values])]

    return _with_codec(docs, path, pattern, key, text, make, "n_tokens long, ids binary")


def decoded(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The key and the ``text`` of each row's ids; null ids give an empty text."""

    def make(own: Codec, values):
        return [("".join(own.decode(np.frombuffer(v or b"", "<u4"))),) for v in values]

    return _with_codec(rows, path, pattern, key, ids, make, "text string")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """The key, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with ``ids``
    also the ids: every text is encoded, its ids hashed, decoded again in a stream
    and the text hashed, so that both exist only while a few texts are worked on.
    Edge cases as for ``encoded``."""

    def make(own: Codec, values):
        for found in own.encode_all([v or "" for v in values]):
            back = hashlib.sha256()
            for part in own.decode(found):
                back.update(part.encode())
            digests = hashlib.sha256(found.tobytes()).hexdigest(), back.hexdigest()
            yield (len(found), found.tobytes(), *digests) if ids else (len(found), *digests)

    extra = "ids binary, " if ids else ""
    return _with_codec(docs, path, pattern, key, text, make, f"n_tokens long, {extra}ids_sha256 string, decoded_sha256 string")
