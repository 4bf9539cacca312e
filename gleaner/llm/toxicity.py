"""Toxicity: a support vector machine on the subsequence string kernel.

Two strings are alike if they share subsequences of ``ORDER`` characters, each
weighted by ``DECAY`` to the power of the span it takes in either string. So an
insult with a gap or an inserted character stays close to the plain one. The
kernel to a few landmark strings (Nyström) turns a string into a short vector
and the machine into a linear function of it.

It is trained on the sentences of a bounded sample of labelled documents. A
sentence of a toxic document need not be toxic itself, so in each round the
string that speaks most for a document stands for it. A document scores as its
worst string.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import bounded_sample

ORDER, DECAY = 4, 0.7
TOXIC_SAMPLE, CLEAN_SAMPLE = 1_200, 2_400  # documents that a model is fitted on, at most
LANDMARKS = 40
NEGATIVES = 15_000  # strings of clean documents in each fit, besides the worst ones of each
ROUNDS = 4
VARIANTS = 6  # of a sure string, with a character put in
SURE_LIFT = 8.0  # log-likelihood gain over the classes' common rate
UNIT = 24  # longer strings are cut into overlapping windows
CACHED = 400_000
BLOCK = 256  # strings whose kernels are worked out together; their tables fit a cache
THRESHOLD = 0.5

_SENTENCE = re.compile(r"[.!?\n]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")
_EDGES = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens of a text, and runs of single characters."""
    text = text.lower()
    found = set(text.split())
    if _SPACED.search(text):
        found |= {m.group() for m in _SPACED.finditer(text)}
    return found


def units(token: str) -> list[str]:
    """The strings that a token is judged by: without signs at its ends, without
    signs at all, long ones in windows that overlap by half. Angle brackets mark
    start and end, so that these count in the kernel like characters."""
    if token.isalnum():  # most are, and have no signs
        strings = {token}
    else:
        plain = _EDGES.sub("", token)
        strings = {plain, _INNER.sub("", plain)}
    out = []
    for string in strings:
        if len(string) < ORDER - 1:
            continue
        string = f"<{string}>"
        if len(string) <= UNIT:
            out.append(string)
        else:
            out += [string[i : i + UNIT] for i in range(0, len(string) - UNIT // 2, UNIT // 2)]
    return out


def _codes(strings: list[str], width: int) -> np.ndarray:
    flat = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(strings), width)


def _kernel_block(strings: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of strings of about equal length to all landmarks.

    A common subsequence weighs the decay to its two spans, that is to its last
    places less its first ones. The first characters carry the one part, the last
    the other, and between them ``near[i][b]`` merely sums over the common
    subsequences of ``i + 1`` characters in the string so far and the first ``b``
    characters of a landmark.
    """
    width = max(map(len, strings))
    s = _codes(strings, width)
    size, length = landmarks.shape
    shape = (len(strings), size)
    table = np.where(landmarks == 0, np.uint32(0xFFFFFFFF), landmarks)
    near = np.zeros((ORDER - 1, length + 1, *shape), np.float32)
    total = np.zeros(shape, np.float32)
    run, step = np.empty(shape, np.float32), np.empty(shape, np.float32)
    for a in range(width):
        same = [s[:, a : a + 1] == table[None, :, b] for b in range(length)]
        hits = [b for b in range(length) if same[b].any()]
        if not hits:
            continue
        match = {b: same[b].astype(np.float32) for b in hits}
        for b in hits:  # the last character of a subsequence
            if b >= ORDER - 1:
                np.multiply(match[b], near[ORDER - 2, b], out=step)
                step *= np.float32(DECAY ** (a + b + 2))
                total += step
        for i in range(ORDER - 2, -1, -1):
            run[:] = 0
            for b in range(hits[0], length):
                if b in match:
                    if i == 0:
                        np.multiply(match[b], np.float32(DECAY ** -(a + b)), out=step)
                    else:
                        np.multiply(match[b], near[i - 1, b], out=step)
                    run += step
                near[i, b + 1] += run
    return total


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each string to each landmark, normalised to 1 for equal ones."""
    if not strings:
        return np.zeros((0, len(landmarks)), np.float32)
    table = _codes(landmarks, max(map(len, landmarks)))
    own = np.array([_own(t) for t in landmarks], np.float32)
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
    for start in range(0, len(order), BLOCK):
        at = order[start : start + BLOCK]
        part = [strings[i] for i in at]
        norm = np.sqrt(_own_block(part)[:, None] * own[None, :])
        out[at] = _kernel_block(part, table) / np.maximum(norm, 1e-9)
    return out


def _own(string: str) -> float:
    return float(_own_block([string])[0])


def _own_block(strings: list[str]) -> np.ndarray:
    """Kernel of each string with itself."""
    width = max(map(len, strings))
    s = _codes(strings, width)
    n = len(strings)
    real = s != 0
    near = [np.zeros((n, width + 1), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(n, np.float32)
    square = np.float32(DECAY * DECAY)
    decay = np.float32(DECAY) ** np.maximum(np.arange(width)[None, :] - np.arange(width)[:, None], 0).astype(np.float32)
    decay = np.triu(decay).astype(np.float32)
    for a in range(width):
        same = ((s == s[:, a : a + 1]) & real & real[:, a : a + 1]).astype(np.float32)
        total += (same * near[ORDER - 2][:, :-1]).sum(1) * square
        for i in range(ORDER - 2, -1, -1):
            fresh = same * square if i == 0 else same * near[i - 1][:, :-1] * square
            near[i] *= DECAY
            near[i][:, 1:] += fresh @ decay
    return total


@dataclass
class Machine:
    """``weights`` of the kernels to ``landmarks``, and the calibration of a
    document's worst margin to a probability."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, strings: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(strings), self.bias)
        return kernel(strings, self.landmarks) @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column
    of ``x`` is the constant and not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        gap = 1 - y * (x @ w)
        on = gap > 0
        active = x[on] * weight[on, None]
        hessian = active.T @ x[on] + np.diag(penalty)
        new = np.linalg.solve(hessian, active.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def sentences(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic") -> DataFrame:
    """``doc``, ``toxic`` and the strings of each sentence of the sampled
    documents. The samples of both classes are bounded and broadcast."""
    sample = bounded_sample(labels.where(F.col(label) == 1), label, key, TOXIC_SAMPLE).union(
        bounded_sample(labels.where(F.col(label) == 0), label, key, CLEAN_SAMPLE)
    )
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(sample), "_key")

    def run(batches):
        for batch in batches:
            out = []
            for key, value, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in _SENTENCE.split(value or ""):
                    found = sorted({u for t in tokens(part) for u in units(t)})
                    if found:
                        out.append((f"{key}", mark, " ".join(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["doc", "toxic", "strings"])

    return rows.mapInArrow(run, "doc string, toxic long, strings string")


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Machine:
    """Fit on the sample (see ``train``)."""
    rows = sentences(docs, labels, **columns).distinct().orderBy("doc", "strings").toArrow()
    return train(rows.column("doc").to_pylist(), rows.column("toxic").to_pylist(), rows.column("strings").to_pylist())


def train(docs: list[str], toxic: list[int], bags: list[str]) -> Machine:
    """A machine from sentences, each given as its strings joined by spaces. Without sentences of
    both classes it is constant: the smoothed share of toxic documents."""
    number = {d: i for i, d in enumerate(dict.fromkeys(docs))}
    y = np.zeros(len(number), np.int64)
    y[[number[d] for d in docs]] = toxic
    if len(number) == 0 or y.min() == y.max():
        odds = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
        return Machine([], np.zeros(0), 0.0, 0.0, odds)
    # equal sentences count once, and as clean if a clean document has one
    seen: dict[str, tuple[int, str]] = {}
    for d, mark, bag in zip(docs, toxic, bags, strict=True):
        seen[bag] = min(seen.get(bag, (mark, d)), (mark, d))
    vocabulary: dict[str, int] = {}
    of, marks, string = array("i"), array("b"), array("i")
    for bag, (mark, d) in seen.items():
        own = [vocabulary.setdefault(s, len(vocabulary)) for s in bag.split(" ")]
        string.extend(own)
        of.extend([number[d]] * len(own))
        marks.extend([mark] * len(own))
    del seen
    of, marks, string = (np.frombuffer(c, t) for c, t in ((of, np.int32), (marks, np.int8), (string, np.int32)))
    names = np.array(list(vocabulary), object)
    in_toxic = np.bincount(string[marks == 1], minlength=len(names))
    in_clean = np.bincount(string[marks == 0], minlength=len(names))
    codes = np.unique(of.astype(np.int64) << 32 | string)
    pairs = np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1)
    expected = (in_toxic + in_clean) * in_toxic.sum() / max((in_toxic + in_clean).sum(), 1)
    lift = np.where(in_toxic > expected, in_toxic * np.log((in_toxic + 0.1) / (expected + 0.1)) - (in_toxic - expected), 0)
    suspects = np.flatnonzero((lift > 3) & (in_toxic >= 3))
    suspects = suspects[np.argsort(-lift[suspects], kind="stable")][:4000]
    landmarks = _cover(names, suspects, pairs, y, lift, LANDMARKS * 3 // 4)
    clean = np.flatnonzero(in_clean > 0)
    clean = clean[np.argsort([hash_of(n) for n in names[clean]], kind="stable")]
    frequent = clean[np.argsort(-in_clean[clean], kind="stable")][: 10 * LANDMARKS : 10]
    landmarks += [n for n in names[frequent] if n not in landmarks][: LANDMARKS - len(landmarks)]

    own = kernel(landmarks, landmarks).astype(float)
    values, vectors = np.linalg.eigh(own + 1e-6 * np.eye(len(own)))
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5) @ vectors.T

    def mapped(strings) -> np.ndarray:
        x = np.ones((len(strings), len(landmarks) + 1), np.float32)
        for i in range(0, len(strings), 20_000):
            x[i : i + 20_000, :-1] = kernel(list(strings[i : i + 20_000]), landmarks) @ root.astype(np.float32)
        return x

    x = mapped(names)
    bad, good = pairs[y[pairs[:, 0]] == 1], pairs[y[pairs[:, 0]] == 0]
    values = lift.copy()  # who speaks for a document: at first the largest lift, then the largest margin
    # strings that hardly any clean sentence has stand for themselves, plain and with characters put in
    sure = np.flatnonzero((lift > SURE_LIFT) & (in_clean <= 0.05 * in_toxic))
    fixed = np.concatenate([x[sure], *[mapped([_inserted(names[i], 7 * i + k) for i in sure]) for k in range(VARIANTS)]])
    hard = np.zeros(0, np.int64)
    for turn in range(ROUNDS):
        best = _best(bad, values, len(y))
        witness = best[best >= 0]
        if turn == 0:
            witness = witness[lift[witness] > 3]
        extra = np.concatenate([mapped([_inserted(names[w], i) for i, w in enumerate(witness)]), fixed])
        calm = np.concatenate([clean[:NEGATIVES], hard])
        rows = np.concatenate([x[witness], extra, x[calm]]).astype(float)
        sign = np.concatenate([np.ones(len(witness) + len(extra)), -np.ones(len(calm))])
        weight = np.concatenate(
            [np.full(2 * len(witness), 200 / max(len(witness), 1)), np.full(len(fixed), 600 / max(len(fixed), 1)), np.full(len(calm) - len(hard), 200 / NEGATIVES), np.full(len(hard), 600 / max(len(hard), 1))]
        )
        w = _squared_hinge(rows, sign, weight)
        values = x @ w
        worst = _best(good, values, len(y))
        hard = np.concatenate([hard, worst[worst >= 0]])[-3 * CLEAN_SAMPLE :]
    machine = Machine(landmarks, root @ w[:-1], float(w[-1]), 1.0, 0.0)
    worst = np.full(len(y), machine.bias)
    np.maximum.at(worst, pairs[:, 0], values[pairs[:, 1]])
    machine.slope, machine.shift = _platt(worst, y)
    return machine


def _best(pairs: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The string with the largest value of each document in ``pairs``, or -1."""
    out = np.full(size, -1)
    order = np.argsort(values[pairs[:, 1]], kind="stable")
    out[pairs[order, 0]] = pairs[order, 1]
    return out


def hash_of(string: str) -> int:
    return zlib.crc32(string.encode())


def _inserted(string: str, seed: int) -> str:
    """The string with one character put in, so that the machine learns to bear it."""
    at = 2 + (seed * 7919) % max(len(string) - 3, 1)
    return string[:at] + "aehirstu"[seed % 8] + string[at:]


def _cover(names, suspects, pairs, y, lift, size: int) -> list[str]:
    """Landmarks that together speak for as many toxic documents as possible:
    the string with the largest lift, then again without the documents of the
    strings close to it."""
    if not len(suspects):
        return []
    place = np.full(len(names), -1)
    place[suspects] = np.arange(len(suspects))
    rows = pairs[(y[pairs[:, 0]] == 1) & (place[pairs[:, 1]] >= 0)]
    doc, string = rows[:, 0], place[rows[:, 1]]
    gain = lift[suspects] / np.maximum(np.bincount(string, minlength=len(suspects)), 1)
    open_docs = np.ones(len(y), bool)
    closed = np.zeros(len(suspects), bool)
    chosen: list[str] = []
    while len(chosen) < size and not closed.all():
        score = np.bincount(string, open_docs[doc].astype(float), len(suspects)) * gain
        if score.max() <= 0:
            open_docs[:] = True  # all covered: go on with further forms
            score = np.bincount(string, minlength=len(suspects)) * gain
        score[closed] = -1
        best = int(score.argmax())
        closed[best] = True
        chosen.append(str(names[suspects[best]]))
        near = np.flatnonzero(kernel([str(n) for n in names[suspects]], [chosen[-1]])[:, 0] > 0.45)
        hit = np.isin(string, near)
        open_docs[doc[hit]] = False
    return chosen


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve; toxic documents are taken to be a third."""
    weight = np.where(y == 1, 1 / max(y.sum(), 1), 2 / max((1 - y).sum(), 1)) * 70
    target = np.where(y == 1, 0.99, 0.01)
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (target - p)) - 1e-3 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
    return float(w[0]), float(w[1])


class _Scorer:
    """Margins of tokens; those seen lately are kept, and those of their strings,
    which differ less."""

    def __init__(self, machine: Machine):
        self._machine, self._known, self._old = machine, {}, {}
        self._margins: dict[str, float] = {}

    def learn(self, wanted: set[str]) -> dict[str, float]:
        """A table with the margins of all ``wanted`` tokens."""
        if len(self._known) > CACHED:
            self._old, self._known = self._known, {}
        known, old = self._known, self._old
        fresh = []
        for token in wanted:
            if token not in known:
                if token in old:
                    known[token] = old[token]
                else:
                    fresh.append(token)
        parts = [(t, units(t)) for t in fresh]
        if len(self._margins) > CACHED:
            self._margins = {}
        margin = self._margins
        every = sorted({u for _, us in parts for u in us if u not in margin})
        margin.update(zip(every, self._machine.margins(every).tolist(), strict=True))
        lowest = self._machine.bias
        for token, own in parts:
            known[token] = max([lowest, *(margin[u] for u in own)])
        return known


def scored(docs: DataFrame, machine: Machine, key="doc_id", text="text", threshold=THRESHOLD) -> DataFrame:
    """Per row of ``docs``: the key, ``score`` (probability of being toxic) and
    ``predicted``. A null or empty text, or one without strings of three
    characters, has the score of the machine's bias. Null and repeated keys are
    passed on row by row; other columns are not read."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches):
        scorer = _Scorer(machine)
        for batch in batches:
            worst, at = np.full(batch.num_rows, machine.bias), 0
            while at < batch.num_rows:  # some hundred thousand tokens at a time
                sets, size = [], 0
                while at + len(sets) < batch.num_rows and size < 200_000:
                    sets.append(tokens(batch.column(1)[at + len(sets)].as_py() or ""))
                    size += len(sets[-1])
                known = scorer.learn(set().union(*sets))
                for i, own in enumerate(sets):
                    if own:
                        worst[at + i] = max(worst[at + i], max(map(known.__getitem__, own)))
                at += len(sets)
            score = machine.probability(worst)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["_key", "score", "predicted"]
            )

    return rows.mapInArrow(run, f"_key {kind}, score double, predicted int").withColumnRenamed("_key", key)
