"""Document fingerprints from content-defined chunks.

A gear hash over the last bytes decides where a chunk ends: up to the normal
size a strict mask must match, beyond it a loose one, so that sizes gather
around the normal one. Boundaries depend on the neighbourhood only; after an
insertion or a cut the chunks fall into step again. A fingerprint is the set of
chunk digests with their lengths, and the likeness of one text to another is the
share of its bytes in chunks that the other has too (containment).
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import numbered_keys
from .words import mixed, text_bytes

LEAST, NORMAL, MOST = 16, 32, 128  # chunk sizes in bytes
STRICT, LOOSE = np.uint32(0x3F << 20), np.uint32(0x0F << 20)
PART_BYTES = 2 << 20
_GEAR = (mixed(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PLACES = mixed(np.arange(5000, 5000 + MOST, dtype=np.uint64)) | np.uint64(1)


def _gear_hash(data: np.ndarray) -> np.ndarray:
    """``h = 2 h + gear[byte]`` in 32 bits at every byte, by doubling: the sums
    over 1, 2, 4, ... 32 bytes."""
    out = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = out[:-step] << np.uint32(step)
        out[step:] += shifted
    return out


def _next_true(mask: np.ndarray) -> np.ndarray:
    """For each place the first place from there on where ``mask`` holds."""
    n = len(mask)
    places = np.where(mask, np.arange(n), n)
    return np.append(np.minimum.accumulate(places[::-1])[::-1], n)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of the chunks of all texts, which lie one after
    another in ``data``; all texts advance by one chunk at a time."""
    strict, loose = _boundaries(data, offsets)
    at, end = offsets[:-1].copy(), offsets[1:]
    alive = np.flatnonzero(at < end)
    texts, starts, ends = [], [], []
    while len(alive):
        here, stop = at[alive], end[alive]
        first = strict[np.minimum(here + LEAST - 1, len(data))] + 1
        late = here + NORMAL
        second = loose[np.minimum(late - 1, len(data))] + 1
        cut = np.where(first <= late, first, second)
        cut = np.minimum(np.minimum(cut, here + MOST), stop)
        texts.append(alive)
        starts.append(here)
        ends.append(cut)
        at[alive] = cut
        alive = alive[cut < stop]
    if not texts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(texts), np.concatenate(starts), np.concatenate(ends)


def _boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the masks match, as tables of the next such place. A hash covers up
    to 32 bytes; near a text's start it covers the text's own bytes only."""
    hashes = _gear_hash(data)
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    near = (begins[:, None] + np.arange(31)[None, :]).ravel()
    near = np.unique(near[near < len(data)])
    if len(near):  # redo the first bytes of each text without those before it
        start = begins[np.searchsorted(begins, near, "right") - 1]
        total = np.zeros(len(near), np.uint32)
        for back in range(32):
            place = near - back
            own = place >= start
            total[own] += _GEAR[data[place[own]]] << np.uint32(back)
        hashes[near] = total
    return _next_true((hashes & STRICT) == 0), _next_true((hashes & LOOSE) == 0)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, digest, length)`` of the distinct chunks of each text, sorted;
    the length is the total of equal chunks."""
    text, start, end = chunk_ends(data, offsets)
    if len(text) == 0:
        return text, text.astype(np.uint64), text
    order = np.argsort(start, kind="stable")
    text, start, end = text[order], start[order], end[order]
    size = end - start
    place = np.arange(len(data)) - np.repeat(start, size)
    products = _PLACES[place]
    products *= data.astype(np.uint64) + np.uint64(1)
    digest = mixed(np.add.reduceat(products, start) ^ (size.astype(np.uint64) << np.uint64(48)))
    order = np.lexsort((digest, text))
    text, digest, size = text[order], digest[order], size[order]
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])])
    return text[first], digest[first], np.add.reduceat(size, np.flatnonzero(first))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


class Prints:
    """Fingerprints of a list of texts, given as UTF-8."""

    def __init__(self, texts: list[bytes]):
        self.text, self.digest, self.size = chunks(*_joined(texts))
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.weight = np.bincount(self.text, self.size, len(texts)) if len(self.text) else np.zeros(len(texts))

    def written(self) -> list[str]:
        """``digest:length`` in hex, by digest, joined by commas."""
        parts = [f"{d:016x}:{n:x}" for d, n in zip(self.digest.tolist(), self.size.tolist(), strict=True)]
        return [",".join(parts[a:b]) for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]

    def within(self, other: Prints, own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Share of text ``own[i]`` that lies in chunks of ``other``'s text
        ``theirs[i]``. Two empty texts are alike (1), an empty one and another
        are not (0)."""
        out = np.zeros(len(own))
        for i, (a, b) in enumerate(zip(own.tolist(), theirs.tolist(), strict=True)):
            x = slice(self.first[a], self.first[a + 1])
            y = other.digest[other.first[b] : other.first[b + 1]]
            mine = self.digest[x]
            if not len(mine) or not len(y):
                out[i] = float(len(mine) == len(y))
                continue
            at = np.minimum(np.searchsorted(y, mine), len(y) - 1)
            out[i] = self.size[x][y[at] == mine].sum() / self.weight[a]
        return out


def fingerprints(docs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Per row of ``docs``: the key, ``n_chars`` and ``fingerprint``, in place. A
    null text counts as empty; its fingerprint is the empty string."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in _parts(batch, 1):
                chars = [len(t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chars, pa.int64()), pa.array(Prints(texts).written())], ["k", "n", "f"])

    return rows.mapInArrow(run, f"_key {kind}, n_chars long, fingerprint string").withColumnRenamed("_key", key)


def _parts(batch: pa.RecordBatch, at: int):
    """The batch in parts of some texts, with their bytes."""
    data, offsets = text_bytes(batch.column(at))
    whole, start = data.tobytes(), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PART_BYTES, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start), [whole[offsets[i] : offsets[i + 1]] for i in range(start, end)]
        start = end


def _borders(order: DataFrame, tasks: int) -> list[tuple]:
    """The first place of each of at most ``tasks`` equal parts of the sorted
    distinct rows of ``order``. Only these come to the driver."""
    numbered = numbered_keys(order.groupBy(*order.columns).agg(F.count("*").alias("_n")).drop("_n"), "number")
    total = numbered.count()
    size = max(1, -(-total // max(1, tasks)))
    return [tuple(r)[:-1] for r in numbered.where(F.col("number") % size == 0).orderBy("number").collect()]


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited form and against the next document.

    Documents are ordered by descending key, null keys last, equal keys by their
    texts' hash; rows equal in key and text are one place in this order, and each
    gives a row of its own. The edited text has the last third of the code points
    replaced by as many (or all) of the next text's first ones; after the last
    document comes the first, and a single one follows itself. A null text
    counts as empty. Other columns are not read.

    Keys alone are sorted first, to cut the order into equal parts; then each
    text moves once, to the task of its part, and the first of a part also to the
    task before, where it is the next of the last.

    Returns the key, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    down = F.coalesce(F.bitwise_not("_key"), F.lit(0))  # descending, without overflow
    rows = rows.select("_key", "_text", F.col("_key").isNull().alias("_last"), down.alias("_down"), F.xxhash64("_text").alias("_hash"))
    borders = _borders(rows.select("_last", "_down", "_hash"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, len(borders))

    def assign(batches):
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True))
            tasks = [bisect.bisect_right(borders, p) - 1 for p in places]
            again = [i for i, (p, t) in enumerate(zip(places, tasks, strict=True)) if parts > 1 and borders[t] == p]
            index = pa.array([*range(len(places)), *again], pa.int64())
            task = [*tasks, *((tasks[i] - 1) % parts for i in again)]
            copy = [False] * len(tasks) + [True] * len(again)
            taken = batch.take(index)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(task, pa.int32()), pa.array(copy)], [*taken.schema.names, "_task", "_copy"])

    schema = "_key long, _text string, _last boolean, _down long, _hash long, _task int, _copy boolean"
    dealt = rows.mapInArrow(assign, schema).repartitionById(parts, F.col("_task"))
    dealt = dealt.sortWithinPartitions("_copy", "_last", "_down", "_hash").select("_key", "_text", "_last", "_down", "_hash", "_copy")

    def run(batches):
        held: list[tuple] = []  # key, place in the order (None for the copy), text
        first, size = None, 0
        for batch in batches:
            keys, *place, copies = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            data, offsets = text_bytes(batch.column(1))
            for i in range(batch.num_rows):
                at = None if copies[i] else tuple(p[i] for p in place)
                own = held[-1][2] if held and held[-1][1] == at else data[offsets[i] : offsets[i + 1]].tobytes()
                held.append((keys[i], at, own))
                size += len(own)
                first = own if first is None else first
                if size > PART_BYTES:
                    done, held = _settled(held)
                    size = sum(len(h[2]) for h in held[:1])
                    if done:
                        yield _compared(done)
        if held and parts == 1:
            held.append((None, None, first))
        done, _ = _settled(held)
        if done:
            yield _compared(done)

    schema = (
        "_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return dealt.mapInArrow(run, schema).withColumnRenamed("_key", key)


def _settled(held):
    """Rows whose next text is known, as ``(key, text, next text)``, and the rest."""
    nexts, following = [None] * len(held), None
    for i in range(len(held) - 2, -1, -1):
        if held[i][1] != held[i + 1][1]:
            following = held[i + 1][2]
        nexts[i] = following
    done = [(h[0], h[2], n) for h, n in zip(held, nexts, strict=True) if n is not None and h[1] is not None]
    rest = [h for h, n in zip(held, nexts, strict=True) if n is None]
    return done, rest


def edited(own: str, following: str) -> str:
    n = len(own) // 3
    return own[: len(own) - n] + following[:n] if n else own


def _compared(rows) -> pa.RecordBatch:
    own = [r[1] for r in rows]
    texts = [t.decode() for t in own]
    changed = [edited(t, r[2].decode()).encode() for t, r in zip(texts, rows, strict=True)]
    follow, number = [], {}
    for r in rows:
        if r[2] not in number:
            number[r[2]] = len(follow)
            follow.append(r[2])
    mine, theirs, nexts = Prints(own), Prints(changed), Prints(follow)
    every = np.arange(len(rows))
    following = np.array([number[r[2]] for r in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
            pa.array(mine.written()),
            pa.array(theirs.written()),
            pa.array(mine.within(theirs, every, every)),
            pa.array(mine.within(nexts, every, following)),
        ],
        ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
