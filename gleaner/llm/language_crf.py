"""Languages of the words of a text by a linear-chain conditional random field.

A word's potentials are sums of learned weights of its affixes, character
n-grams and its entry in the (hashed) lexicon; neighbouring words share learned
transition weights, so that a run of words in another language is followed but a
single odd word is not. Marginals come from the forward-backward recursion over
the whole text. Texts are cut into blocks of ``BLOCK`` words: a transfer matrix
of each block gives the messages at its ends, then all blocks of a batch are
swept at the same time. The result is the exact recursion, whatever the length.

The weights are fitted on a bounded sample: a piece of at most ``PIECE`` words of
at most ``PER_LANGUAGE`` documents of each of at most ``LANGUAGES`` languages
(the most frequent ones). A third of the pieces are spliced from two documents,
which is where switches are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .words import SLICE_BYTES, Words, cut, gathered, mixed, slices

PER_LANGUAGE, LANGUAGES = 1_000, 64  # documents of a language, languages
PIECE, WORD_BYTES = 48, 64  # words of a document, bytes of a word that a model is fitted on, at most
BUCKETS = 1 << 16
EPOCHS, BATCH, RATE, RIDGE, SPLICED = 4, 64, 0.2, 1e-5, 1 / 3
BLOCK = 128
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_HEAD, _TAIL = 0x5E, 0x24  # marks of a word's ends; neither is a letter


def word_features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of lower-cased words: ``(bucket, valid, first)``.

    The letters of each word are put between two marks. Row ``n`` of ``bucket``
    holds by first byte the pairs, the triples and the runs of four that touch a
    mark (the affixes) and, at a word's first byte, the word as a whole; ``first``
    are the words' first bytes. A word without letters has its two marks only.
    """
    body, offsets = gathered(data, starts, lengths)
    letter = _LETTER[body]
    kept = np.concatenate([[0], np.cumsum(letter)])[offsets]
    size = np.diff(kept)
    first = kept[:-1] + 2 * np.arange(len(size))
    marked = np.empty(int(kept[-1]) + 2 * len(size), np.uint8)
    inside = np.ones(len(marked), bool)
    inside[first] = inside[first + size + 1] = False
    marked[first], marked[first + size + 1] = _HEAD, _TAIL
    marked[inside] = body[letter]
    ends = np.repeat(first + size + 2, size + 2)
    place = np.arange(len(marked))
    wide = np.zeros(len(marked) + 3, np.uint64)
    wide[: len(marked)] = marked
    code = wide[: len(marked)].copy()
    buckets, valid = [], []
    for n in (2, 3, 4):
        code = (code << np.uint64(8)) | wide[n - 1 : n - 1 + len(marked)]
        fits = place + n <= ends
        if n == 4:
            fits &= (marked == _HEAD) | (place + n == ends)
        buckets.append(mixed(code ^ np.uint64(n << 40)))
        valid.append(fits)
    whole = Words(np.append(marked, 0x20), first, first + size + 2, np.array([0, len(first)]))
    lexicon, at_head = np.zeros(len(marked), np.uint64), np.zeros(len(marked), bool)
    lexicon[first], at_head[first] = whole.hashes(), True
    table = np.stack([*buckets, lexicon]) % np.uint64(BUCKETS) if len(marked) else np.zeros((4, 0))
    return table.astype(np.int64), np.stack([*valid, at_head]), first


def potentials(weights: np.ndarray, bucket: np.ndarray, valid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the weights of each word's features, by language."""
    if len(first) == 0:
        return np.zeros((0, weights.shape[1]))
    total = np.zeros((len(first), weights.shape[1]))
    for row, fits in zip(bucket, valid, strict=True):
        part = weights[row]
        part[~fits] = 0
        total += np.add.reduceat(part, first, axis=0)
    return total


def _unique(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct words, and the distinct word of every word."""
    _, place, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return place, which


@dataclass
class Chain:
    """``weights`` by bucket and language, ``switch`` (log) from language to language."""

    languages: list[str]
    weights: np.ndarray
    switch: np.ndarray

    def word_potentials(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positive potentials of the distinct words, and each word's entry."""
        place, which = _unique(words)
        features = word_features(words.data, words.starts[place], words.ends[place] - words.starts[place])
        log = potentials(self.weights, *features)
        return np.exp(log - log.max(1, keepdims=True)) if len(log) else log, which

    def marginals(self, column: pa.Array, words_too: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Per text the sum over its words of the marginals of each language and,
        if asked for, the marginals of every word."""
        words = cut(column, lower=True)
        potential, which = self.word_potentials(words)
        return forward_backward(potential, which, words.first, self.switch, words_too)


def forward_backward(potential, which, first, switch, words_too=False) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact marginals of chains: chain ``d`` has the words ``first[d]`` to
    ``first[d + 1]``, word ``w`` the potentials ``potential[which[w]]``."""
    n_langs, n_words = len(switch), int(first[-1])
    step = np.exp(switch - switch.max())
    texts = len(first) - 1
    each = np.full((n_words, n_langs), 0.0) if words_too else None
    if n_words == 0:
        return np.zeros((texts, n_langs)), each
    number = -(-np.diff(first) // BLOCK)
    of = np.repeat(np.arange(texts), number)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)  # place of a block in its text
    begin = first[of] + turn * BLOCK
    length = np.minimum(first[of + 1] - begin, BLOCK)
    by_length = np.argsort(-length, kind="stable")
    of, turn, begin, length = of[by_length], turn[by_length], begin[by_length], length[by_length]
    opening = np.where((turn == 0)[:, None, None], 1.0, step)  # nothing stands before a text's first word
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length.max()))]  # blocks of more than t words

    def local(t: int, k: int) -> np.ndarray:
        return potential[which[begin[:k] + t]]

    incoming = np.full((len(of), n_langs), 1 / n_langs)
    outgoing = np.ones((len(of), n_langs))
    deepest = int(turn.max())
    if deepest:
        transfer = np.empty((len(of), n_langs, n_langs))
        for t, k in enumerate(active):
            now = opening[:k] if t == 0 else transfer[:k] @ step
            now = now * local(t, k)[:, None, :]
            transfer[:k] = now / now.max(axis=(1, 2), keepdims=True)
        order = np.lexsort((turn, of))
        where = np.empty_like(order)
        where[order] = np.arange(len(order))  # place of a block in (text, turn) order
        by_turn = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by_turn], np.arange(deepest + 2))
        last = number[of] - 1 == turn
        for t in range(1, deepest + 1):
            here = by_turn[cuts[t] : cuts[t + 1]]
            before = order[where[here] - 1]
            message = np.einsum("bi,bij->bj", incoming[before], transfer[before])
            incoming[here] = message / message.sum(1, keepdims=True)
        for t in range(deepest - 1, -1, -1):
            here = by_turn[cuts[t] : cuts[t + 1]]
            here = here[~last[here]]
            after = order[where[here] + 1]
            message = np.einsum("bij,bj->bi", transfer[after], outgoing[after])
            outgoing[here] = message / message.max(1, keepdims=True)
    forward = np.empty((len(active), len(of), n_langs))
    for t, k in enumerate(active):
        reached = np.einsum("bi,bij->bj", incoming, opening) if t == 0 else forward[t - 1, :k] @ step
        reached = reached * local(t, k)
        forward[t, :k] = reached / reached.sum(1, keepdims=True)
    back, total = outgoing, np.zeros((len(of), n_langs))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        if t + 1 < len(active):
            more = active[t + 1]
            message = (back[:more] * local(t + 1, more)) @ step.T
            back[:more] = message / message.max(1, keepdims=True)
        marginal = forward[t, :k] * back[:k]
        marginal /= marginal.sum(1, keepdims=True)
        total[:k] += marginal
        if each is not None:
            each[begin[:k] + t] = marginal
    out = np.zeros((texts, n_langs))
    np.add.at(out, of, total)
    return out, each


def _expected(potential: np.ndarray, switch: np.ndarray, filled: np.ndarray):
    """Marginals of words ``[s, t, l]`` and summed marginals of neighbours."""
    step = np.exp(switch - switch.max())
    n, length, _ = potential.shape
    forward, back = np.empty_like(potential), np.ones_like(potential)
    for t in range(length):
        now = potential[:, t] if t == 0 else (forward[:, t - 1] @ step) * potential[:, t]
        now = np.where(filled[:, t, None], now, 1.0)
        forward[:, t] = now / now.sum(1, keepdims=True)
    pairs = np.zeros_like(step)
    for t in range(length - 1, 0, -1):
        behind = potential[:, t] * back[:, t]
        message = np.where(filled[:, t, None], behind @ step.T, 1.0)
        back[:, t - 1] = message / message.sum(1, keepdims=True)
        both = forward[:, t - 1, :, None] * step * behind[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += both[filled[:, t]].sum(0)
    marginal = forward * back
    return marginal / marginal.sum(2, keepdims=True), pairs


def fit_chain(pieces: list[str], labels: list[str], seed: int = 1) -> Chain:
    """Maximum likelihood by AdaGrad. Without pieces the model knows no language."""
    languages = sorted(set(labels))
    count = len(languages)
    chain = Chain(languages, np.zeros((BUCKETS, count)), np.zeros((count, count)))
    if count < 2:
        return chain
    draw = np.random.default_rng(seed)
    words = cut(pa.array(pieces, pa.string()), lower=True)
    place, which = _unique(words)
    bucket, valid, first = word_features(words.data, words.starts[place], words.ends[place] - words.starts[place])
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, bucket.shape[1])))
    flat = [(bucket[i][valid[i]], owner[valid[i]]) for i in range(len(bucket))]
    feature, of_word = (np.concatenate(x) for x in zip(*flat, strict=True))
    order = np.argsort(of_word, kind="stable")
    feature, bounds = feature[order], np.searchsorted(of_word[order], np.arange(len(first) + 1))
    code = {name: i for i, name in enumerate(languages)}
    truth = np.array([code[x] for x in labels])
    rows = np.flatnonzero(np.diff(words.first) > 0)

    def sequence(i: int, other: int | None) -> tuple[np.ndarray, np.ndarray]:
        mine = np.arange(words.first[i], words.first[i + 1])
        if other is None:
            return which[mine], np.full(len(mine), truth[i])
        theirs = np.arange(words.first[other], words.first[other + 1])
        mine, theirs = mine[: draw.integers(1, len(mine) + 1)], theirs[: draw.integers(1, len(theirs) + 1)]
        return which[np.concatenate([mine, theirs])], np.concatenate([np.full(len(mine), truth[i]), np.full(len(theirs), truth[other])])

    seen_w, seen_s = np.full(chain.weights.shape, 1e-6), np.full(chain.switch.shape, 1e-6)
    for _ in range(EPOCHS):
        shuffled = draw.permutation(rows)
        for at in range(0, len(shuffled), BATCH):
            batch = [sequence(i, int(draw.choice(rows)) if draw.random() < SPLICED else None) for i in shuffled[at : at + BATCH]]
            longest = max(len(x) for x, _ in batch)
            word, label = np.zeros((2, len(batch), longest), np.int64)
            filled = np.zeros((len(batch), longest), bool)
            for j, (x, y) in enumerate(batch):
                word[j, : len(x)], label[j, : len(x)], filled[j, : len(x)] = x, y, True
            local, inverse = np.unique(word[filled], return_inverse=True)
            spans = bounds[local + 1] - bounds[local]
            chosen, offsets = gathered(feature, bounds[local], spans)
            log = np.add.reduceat(chain.weights[chosen], offsets[:-1], axis=0)
            table = np.exp(log - log.max(1, keepdims=True))
            potential = np.ones((*word.shape, count))
            potential[filled] = table[inverse]
            marginal, pairs = _expected(potential, chain.switch, filled)
            off = -marginal[filled]
            off[np.arange(len(off)), label[filled]] += 1
            pull = np.stack([np.bincount(inverse, off[:, c], len(local)) for c in range(count)], 1)
            pull = np.repeat(pull, spans, axis=0)
            touched, spot = np.unique(chosen, return_inverse=True)
            gradient = np.stack([np.bincount(spot, pull[:, c], len(touched)) for c in range(count)], 1) - RIDGE * chain.weights[touched]
            seen_w[touched] += gradient**2
            chain.weights[touched] += RATE * gradient / np.sqrt(seen_w[touched])
            known = filled[:, 1:]
            met = np.bincount((label[:, :-1] * count + label[:, 1:])[known], minlength=count**2).reshape(count, count)
            gradient = met - pairs - RIDGE * chain.switch
            seen_s += gradient**2
            chain.switch += RATE * gradient / np.sqrt(seen_s)
    return chain


def sample_pieces(docs: DataFrame, key="doc_id", text="text", lang="lang") -> DataFrame:
    """``(lang, piece)``: at most ``PIECE`` consecutive words, from a place that a
    hash of the key draws, of at most ``PER_LANGUAGE`` documents of each of the
    ``LANGUAGES`` most frequent languages."""
    known = docs.select(*(F.col(f"`{c}`").alias(f"_{n}") for n, c in (("key", key), ("text", text), ("lang", lang))))
    known = known.where("_key is not null and _text is not null and _lang is not null")
    most = known.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES).collect()
    # about twice as many as wanted are ranked, so that no task ranks a whole language
    share = {r["_lang"]: min(2**63 - 1, 2**64 * PER_LANGUAGE // r["count"]) for r in most}
    limit = F.create_map(*(F.lit(x) for pair in share.items() for x in pair)) if share else F.create_map().cast("map<string,long>")
    place = Window.partitionBy("_lang").orderBy("_hash", "_key")
    hashed = known.select("_key", "_lang", F.xxhash64("_key").alias("_hash"))
    near = hashed.where(F.col("_hash").bitwiseAND(F.lit(2**63 - 1)) <= F.try_element_at(limit, "_lang"))
    drawn = near.withColumn("_place", F.row_number().over(place))
    drawn = F.broadcast(drawn.where(F.col("_place") <= PER_LANGUAGE).select("_key", "_lang", "_hash").distinct())
    rows = known.join(drawn, ["_key", "_lang"]).select("_lang", "_hash", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = cut(part.column(2))
                out = []
                for i, draw in enumerate(part.column(1).to_pylist()):
                    begin, end = int(words.first[i]), int(words.first[i + 1])
                    begin += draw % max(1, end - begin - PIECE + 1)
                    chosen = (words.text(w, w + 1)[:WORD_BYTES].decode("utf-8", "ignore") for w in range(begin, min(end, begin + PIECE)))
                    out.append(" ".join(chosen))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["lang", "piece"])

    return rows.mapInArrow(run, "lang string, piece string")


def fit(docs: DataFrame, **columns: str) -> Chain:
    """Fit on the labelled documents ``docs``; rows without key, text or language
    are left out, a key that occurs twice counts with each of its texts."""
    found = sample_pieces(docs, **columns).toPandas()
    found = found.sort_values(["lang", "piece"])
    return fit_chain(found["piece"].tolist(), found["lang"].tolist())


def predicted(docs: DataFrame, model: Chain, key="doc_id", text="text") -> DataFrame:
    """Per row of ``docs``: the key, ``lang_pred`` and ``score``, the language with
    the largest mean marginal over all words of the text, and that mean.

    A text that is null, empty or without a letter is ``und`` with score 0, and so
    is every text if the model knows no language. Ties go to the first language by
    code point. Null and repeated keys are passed on row by row, other columns are
    not read, and texts of any length are taken whole: memory follows the longest
    text (about 100 bytes a word and language).
    """
    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.when(lettered, F.col(f"`{text}`")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    budget = SLICE_BYTES * 4 // max(4, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, "_text", budget):
                empty = np.asarray(part.column(1).is_null())
                score, best = np.zeros(len(empty)), np.full(len(empty), len(names) - 1)
                if model.languages:
                    sums, _ = model.marginals(part.column(1))
                    mean = sums / np.maximum(sums.sum(1, keepdims=True), 1)
                    known = ~empty & (sums.sum(1) > 0)
                    best[known] = mean[known].argmax(1)
                    score[known] = np.minimum(mean[known].max(1), 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["_key", "lang_pred", "score"]
                )

    return rows.mapInArrow(run, f"_key {kind}, lang_pred string, score double").withColumnRenamed("_key", key)


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
