"""The lazily determinised transducer run over many pieces at a time, in NumPy.

All pieces of a batch read their next byte together: one look-up in a table of
moves. Moves that are missing are worked out together too, each state being a row
of arrays. A state and what it means is that of ``byte_bpe.Transducer``: the last
certain token, the bytes since, and the tokens of the beginnings of these bytes.
"""

from __future__ import annotations

import numpy as np

from .words import gathered

WIDTH = 32  # bytes since the last certain token, plus one; beyond, a piece is read by itself
STATES = 150_000  # held before a batch starts anew
PAIRS = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Non-negative numbers by non-negative 64-bit keys: open addressing, look-ups
    and insertions of whole arrays."""

    def __init__(self, bits: int = 12):
        self._start(bits)

    def _start(self, bits: int) -> None:
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        self._bits, self.size = bits, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``, -1 where there is none."""
        slot = self._slot(keys)
        met = self._keys[slot]
        out = np.where(met == keys, self._values[slot], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self._mask
            met = self._keys[slot]
            same = met == keys[left]
            out[left[same]] = self._values[slot[same]]
            going = ~same & (met >= 0)
            left, slot = left[going], slot[going]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the map does not have."""
        if 2 * (self.size + len(keys)) > len(self._keys):
            held = self._keys >= 0
            old = self._keys[held], self._values[held]
            bits = self._bits
            while 2 * (len(old[0]) + len(keys)) > 1 << bits:
                bits += 1
            self._start(bits)
            self._fill(*old)
        self._fill(keys, values)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.size += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] < 0
            self._keys[slot[free]] = keys[free]  # of several for one slot, one stays
            mine = self._keys[slot] == keys
            self._values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & self._mask


class _Table:
    """Arrays that grow by rows."""

    def __init__(self, **columns: tuple[tuple[int, ...], type]):
        self._columns = columns
        self.clear()

    def clear(self) -> None:
        self.size = 0
        for name, (shape, kind) in self._columns.items():
            setattr(self, name, np.zeros((1024, *shape), kind))

    def add(self, **rows: np.ndarray) -> np.ndarray:
        """The numbers of the new rows."""
        count = len(next(iter(rows.values())))
        for name, values in rows.items():
            own = getattr(self, name)
            if self.size + count > len(own):
                grown = np.zeros((max(2 * len(own), self.size + count), *own.shape[1:]), own.dtype)
                grown[: self.size] = own[: self.size]
                setattr(self, name, grown)
                own = grown
            own[self.size : self.size + count] = values
        self.size += count
        return np.arange(self.size - count, self.size)


def _walk(starts: np.ndarray, tokens: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens on the paths from place ``at`` of each row to 0, in reading order, by
    row: the tokens and the n + 1 offsets."""
    place, steps = at.astype(np.int64), []
    who = np.flatnonzero(place > 0)
    while len(who):
        here = rows[who], place[who]
        steps.append((who, tokens[here]))
        place[who] = starts[here]
        who = who[place[who] > 0]
    number = np.zeros(len(rows), np.int64)
    for who, _ in steps:
        number[who] += 1
    offsets = np.concatenate([[0], np.cumsum(number)])
    out, left = np.zeros(offsets[-1], np.int32), offsets[1:].copy()
    for who, found in steps:
        left[who] -= 1
        out[left[who]] = found
    return out, offsets


class Lanes:
    """``trie`` and ``ending`` are the vocabulary's, ``adjacent(left, right)`` tells
    whether two tokens can stand side by side (left -1: at a piece's start)."""

    def __init__(self, trie: dict[int, int], ending: list[int], adjacent):
        self._trie, self._ending, self._adjacent = IntMap(20), np.array(ending, np.int32), adjacent
        self._trie.put(np.fromiter(trie.keys(), np.int64, len(trie)), np.fromiter(trie.values(), np.int32, len(trie)))
        wide = (WIDTH,)
        self._state = _Table(
            token=((), np.int32), length=((), np.int8), data=(wide, np.uint8), start=(wide, np.int8), last=(wide, np.int32), node=(wide, np.int32)
        )
        self._move = _Table(to=((), np.int32), begin=((), np.int64), count=((), np.int16))
        self._weights = np.random.default_rng(1).integers(1, 1 << 62, WIDTH + 2, np.int64) | 1
        self._pairs = IntMap()
        self.clear()

    def clear(self) -> None:
        self._state.clear()
        self._move.clear()
        self._moves, self._known = IntMap(), IntMap()
        self._out = _Table(token=((), np.int32))
        zero = np.zeros((1, WIDTH), np.int32)
        self._state.add(token=np.array([-1]), length=np.array([0]), data=zero, start=zero, last=zero - 1, node=np.where(np.arange(WIDTH) == 0, 0, -1)[None])

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces one after another, their n + 1 offsets, and whether
        a piece was read (of one that was not, the tokens mean nothing)."""
        if self._state.size > STATES:
            self.clear()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        begin, size = (np.cumsum(size) - size)[order], size[order]
        state, read = np.zeros(len(size), np.int64), np.ones(len(size), bool)
        lanes, tokens = [], []
        for t in range(int(size[0]) if len(size) else 0):
            count = int(np.searchsorted(-size, -t, "left"))
            key = state[:count] << 8 | data[begin[:count] + t]
            move = self._moves.get(key)
            missing = move < 0
            if missing.any():
                self._make(np.unique(key[missing]))
                move[missing] = self._moves.get(key[missing])
            state[:count] = self._move.to[move]
            lost = np.flatnonzero(state[:count] < 0)
            read[lost], state[lost] = False, 0
            number = self._move.count[move].astype(np.int64)
            who = np.flatnonzero(number)
            if len(who):
                found, _ = gathered(self._out.token, self._move.begin[move[who]], number[who])
                lanes.append(np.repeat(who, number[who]))
                tokens.append(found)
        found, offsets = _walk(self._state.start, self._state.last, state, self._state.length[state])
        lanes.append(np.repeat(np.arange(len(state)), np.diff(offsets)))
        tokens.append(found)
        lane, token = order[np.concatenate(lanes)], np.concatenate(tokens)
        placed = np.argsort(lane, kind="stable")  # steps follow one another already
        number = np.bincount(lane, minlength=len(pieces))
        back = np.empty(len(pieces), bool)
        back[order] = read
        return token[placed], np.concatenate([[0], np.cumsum(number)]), back

    def _good(self, left: np.ndarray, last: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) + 1) << 32 | last
        found = self._pairs.get(key)
        if (found < 0).any():
            new = np.unique(key[found < 0])
            if self._pairs.size + len(new) > PAIRS:
                self._pairs = IntMap()
                new = np.unique(key)
            told = [self._adjacent((k >> 32) - 1, k & 0xFFFFFFFF) for k in new.tolist()]
            self._pairs.put(new, np.array(told, np.int32))
            found = self._pairs.get(key)
        return found == 1

    def _make(self, keys: np.ndarray) -> None:
        """Work out the moves ``state << 8 | byte``."""
        own, old, byte = self._state, keys >> 8, (keys & 255).astype(np.uint8)
        size = own.length[old].astype(np.int64) + 1
        fits = size < WIDTH
        if not fits.all():
            lost = np.flatnonzero(~fits)
            made = self._move.add(to=np.full(len(lost), -1), begin=np.zeros(len(lost)), count=np.zeros(len(lost)))
            self._moves.put(keys[lost], made)
            keys, old, byte, size = keys[fits], old[fits], byte[fits], size[fits]
        if not len(keys):
            return
        rows = np.arange(len(keys))
        token, data, start, last, node = (x[old] for x in (own.token, own.data, own.start, own.last, own.node))
        data[rows, size - 1] = byte
        below = np.full(node.shape, -1, np.int32)
        alive = node >= 0
        below[alive] = self._trie.get(node[alive].astype(np.int64) << 8 | np.broadcast_to(byte[:, None], node.shape)[alive])
        ends = np.where(below >= 0, self._ending[below], -1)
        left = last.copy()
        left[:, 0] = token
        open_rows = rows
        while len(open_rows):  # from the shortest token that could end here
            place = WIDTH - 1 - (ends[open_rows, ::-1] >= 0).argmax(1)
            good = self._good(left[open_rows, place], ends[open_rows, place])
            done = open_rows[good]
            start[done, size[done]], last[done, size[done]] = place[good], ends[done, place[good]]
            open_rows, place = open_rows[~good], place[~good]
            ends[open_rows, place] = -1
        below[rows, size] = 0
        # the deepest beginning that all open ones go through
        on = below >= 0
        number = on.sum(1)
        for p in range(int(size.max()), 0, -1):
            climb = np.flatnonzero(on[:, p] & (number > 1))
            if len(climb):
                on[climb, p] = False
                to = start[climb, p]
                number[climb] -= on[climb, to]
                on[climb, to] = True
        sure = on.argmax(1)
        out, offsets = _walk(start, last, rows, sure)
        moved = np.flatnonzero(sure > 0)
        if len(moved):
            by = sure[moved, None]
            token[moved] = last[moved, sure[moved]]
            index = np.minimum(np.arange(WIDTH) + by, WIDTH - 1)
            inside = np.arange(WIDTH) + by < WIDTH
            size[moved] -= sure[moved]
            data[moved] = np.where(inside, np.take_along_axis(data[moved], index, 1), 0)
            below[moved] = np.where(inside, np.take_along_axis(below[moved], index, 1), -1)
            shifted = np.take_along_axis(start[moved], index, 1) - by
            kept = inside & (shifted >= 0) & (np.arange(WIDTH) <= size[moved, None])
            last[moved] = np.where(kept, np.take_along_axis(last[moved], index, 1), -1)
            start[moved] = np.where(kept, shifted, 0)
        with np.errstate(over="ignore"):
            name = (data.astype(np.int64) + 1) @ self._weights[:WIDTH] + token * self._weights[WIDTH] + size * self._weights[WIDTH + 1]
        name &= (1 << 63) - 1
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        known = self._known.get(name[first])
        fresh = first[known < 0]
        made = own.add(token=token[fresh], length=size[fresh], data=data[fresh], start=start[fresh], last=last[fresh], node=below[fresh])
        self._known.put(name[fresh], made)
        known[known < 0] = made
        to = known[which]
        # two states of one name: the later one stands for itself
        odd = np.flatnonzero((own.token[to] != token) | (own.length[to] != size) | (own.data[to] != data).any(1))
        if len(odd):
            to[odd] = own.add(token=token[odd], length=size[odd], data=data[odd], start=start[odd], last=last[odd], node=below[odd])
        begin = self._out.size + offsets[:-1]
        self._out.add(token=out)
        self._moves.put(keys, self._move.add(to=to, begin=begin, count=np.diff(offsets)))
