"""The chain of word languages: features, recursion, fit, held-out accuracy."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import language_crf as crf
from gleaner.llm.words import cut

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["schn", "ung", "ber"], "cc": ["qué", "ción", "ñu"]}


def words_of(draw, lang, n):
    return [("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4)))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    draw = random.Random(1)
    labels = [draw.choice(list(SYLLABLES)) for _ in range(200)]
    return crf.fit_chain([" ".join(words_of(draw, g, 30)) for g in labels], labels)


def brute_features(word):
    """Sizes of the feature groups of one word, from its definition."""
    letters = bytes(b for b in word.encode().lower() if 97 <= b <= 122 or b >= 128)
    marked = b"^" + letters + b"$"
    grams = [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
    grams += [g for i in range(len(marked) - 3) for g in [marked[i : i + 4]] if g[:1] == b"^" or g[-1:] == b"$"]
    return [*grams, marked]


def test_features_by_definition():
    texts = ["Hello, world", "a", "12 !!", "Éa é", "naïve-test", "x" * 3000]
    words = cut(pa.array(texts), lower=True)
    bucket, valid, first = crf.word_features(words.data, words.starts, words.ends - words.starts)
    bounds = np.append(first, bucket.shape[1])
    listed = [w for t in texts for w in t.split()]
    seen = {}
    for i, word in enumerate(listed):
        mine = slice(bounds[i], bounds[i + 1])
        got = [int(b) for row, fits in zip(bucket[:, mine], valid[:, mine], strict=True) for b in row[fits]]
        want = brute_features(word)
        assert len(got) == len(want)
        ordered = sorted(want[:-1], key=len)
        for gram, code in zip([*ordered, want[-1] + b" "], got, strict=True):
            assert seen.setdefault(gram, code) == code


def test_recursion_is_exact():
    draw = np.random.default_rng(2)
    first = np.cumsum([0, 1, 5, 0, 3])
    potential, which = draw.random((6, 3)) + 0.1, draw.integers(0, 6, first[-1])
    switch = draw.normal(0, 1, (3, 3))
    sums, each = crf.forward_backward(potential, which, first, switch, True)
    for d in range(4):
        chain = which[first[d] : first[d + 1]]
        want = np.zeros((len(chain), 3))
        for path in itertools.product(range(3), repeat=len(chain)):
            weight = np.prod([potential[w, y] for w, y in zip(chain, path, strict=True)] or [0])
            weight *= np.exp(sum(switch[a, b] for a, b in itertools.pairwise(path)))
            for t, y in enumerate(path):
                want[t, y] += weight
        want /= want.sum(1, keepdims=True) if len(chain) else 1
        assert np.allclose(each[first[d] : first[d + 1]], want)
        assert np.allclose(sums[d], want.sum(0))


def test_blocks_do_not_show(monkeypatch):
    draw = np.random.default_rng(3)
    first = np.cumsum([0, 700, 3, 257, 0, 128, 129])
    potential, which = draw.random((50, 4)) + 0.01, draw.integers(0, 50, first[-1])
    switch = draw.normal(0, 2, (4, 4))
    monkeypatch.setattr(crf, "BLOCK", 10_000)
    sums, each = crf.forward_backward(potential, which, first, switch, True)
    for block in (1, 7, 128):
        monkeypatch.setattr(crf, "BLOCK", block)
        other, words = crf.forward_backward(potential, which, first, switch, True)
        assert np.allclose(sums, other) and np.allclose(each, words)


def test_code_switched_words(model):
    draw = random.Random(9)
    right = total = 0
    for _ in range(40):
        one, two = draw.sample(list(SYLLABLES), 2)
        text = words_of(draw, one, 12) + words_of(draw, two, 12)
        _, each = model.marginals(pa.array([" ".join(text)]), True)
        got = [model.languages[i] for i in each.argmax(1)]
        right += sum(a == b for a, b in zip(got, [one] * 12 + [two] * 12, strict=True))
        total += 24
    assert right / total > 0.95


def test_awkward_rows(spark, docs, no_docs, rows):
    model = crf.fit(docs)
    got = crf.predicted(docs, model).collect()
    assert len(got) == len(rows)
    for want in [(r[0], r[1]) for r in rows]:
        mine = [r for r in got if r["doc_id"] == want[0]]
        assert mine
    by_key = {r["doc_id"]: r for r in got}
    for key in (6, 7, 8):
        assert by_key[key]["lang_pred"] == "und" and by_key[key]["score"] == 0
    assert all(r["lang_pred"] in ("en", "de", "xx", "und") and 0 <= r["score"] <= 1 for r in got)
    assert crf.predicted(no_docs, model).collect() == []
    nothing = crf.fit(no_docs)
    assert {r["lang_pred"] for r in crf.predicted(docs, nothing).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 !?"), (2, "12 a")], "doc_id BIGINT, text STRING")
    assert [r["lang_pred"] == "und" for r in crf.predicted(digits, model).orderBy("doc_id").collect()] == [True, False]


def test_long_text(model, spark):
    draw = random.Random(4)
    text = " ".join(words_of(draw, "bb", 200_000))
    frame = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    row = crf.predicted(frame, model).first()
    assert row["lang_pred"] == "bb" and row["score"] > 0.9


def test_held_out_accuracy(spark):
    from gleaner.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    found = REGISTRY["op12_language_chain"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert found.count() == docs.count()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_labels_kept_out_are_not_read(spark):
    """Labels of held-out documents change nothing."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    kept = crf.held_out(F.col("doc_id"))
    spoiled = docs.withColumn("lang", F.when(kept, "zz").otherwise(F.col("lang")))
    one, two = crf.fit(docs.where(~kept)), crf.fit(spoiled.where(~kept))
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)
