import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import boilerplate, language, lookup, perplexity, pooling, probe, ridge
from gleaner.operators.scores import macro_metrics

DOCS = [
    (1, "the cat and the dog", "en"), (2, "the end of the road", "en"), (3, "le chat et le chien", "fr"),
    (4, "la fin de la route", "fr"), (5, "der hund und die katze", "de"), (6, "", "de"),
    (7, "the the the the unseenword", None), (8, "123 !", None), (9, "zzz", None),
]


def tokens(t):
    return re.findall(r"[^\W\d_]+", t.lower())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id INT, text STRING, lang STRING")


def naive_bayes():
    counts = {}
    for _, text, lang in DOCS:
        if lang:
            counts.setdefault(lang, Counter()).update(tokens(text))
    vocabulary = len(set().union(*counts.values()))
    scores = {}
    for i, text, _ in DOCS:
        found = tokens(text)
        if found:
            s = {
                l: sum(math.log((c[t] + 1) / (sum(c.values()) + vocabulary)) for t in found) / len(found)
                for l, c in counts.items()
            }
            z = sum(math.exp(v) for v in s.values())
            scores[i] = {l: math.exp(v) / z for l, v in s.items()}
    return scores


# 150 bytes hold no more than a few keys, so most go through the tail join.
@pytest.mark.parametrize("budget", [1 << 28, 150, 0])
def test_language_scores_equal_brute_force(docs, budget):
    model = language.fit_language_model(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {}
    for r in language.language_scores(docs, model, budget=budget).collect():
        got.setdefault(r["doc_id"], {})[r["lang"]] = r["p"]
    want = naive_bayes()
    assert got.keys() == want.keys() == {1, 2, 3, 4, 5, 7, 9}
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-12)


def test_head_and_tail_partition_the_weights(docs):
    model = language.fit_language_model(docs)
    weights = model.tokens.select("key", "n", F.col("c0").alias("w"))
    split = lookup.split_weights(weights, budget=150)
    assert split.head.count() > 0 and split.tail.count() > 0
    assert split.head.count() + split.tail.count() == weights.count()
    assert "the" in [r["key"] for r in split.head.collect()]
    assert lookup.split_weights(weights).tail is None


def test_language_filter(docs):
    model = language.fit_language_model(docs)
    want = naive_bayes()
    top = {r["doc_id"]: (r["lang"], r["p"]) for r in language.top_language(docs, model).collect()}
    for i, scores in want.items():
        best = min(scores, key=lambda l: (-round(scores[l], 12), l))
        assert top[i] == (best, pytest.approx(scores[best]))
    english = {i for i, (l, _) in top.items() if l == "en"}
    limit = sorted(top[i][1] for i in english)[0]
    assert {r["doc_id"] for r in language.keep_language(docs, model, above=None).collect()} == english
    strict = {r["doc_id"] for r in language.keep_language(docs, model, above=limit).collect()}
    assert strict == {i for i in english if top[i][1] > limit} != english


@pytest.mark.parametrize("budget", [1 << 28, 400, 150, 0])
@pytest.mark.parametrize("above", [0.6, 0.34, None])
def test_verdict_where_the_text_lies(spark, docs, budget, above):
    """Whatever part of the tokens the tasks hold, the rows are those of all scores;
    without rare tokens nothing moves, and with them only texts they decide."""
    model = language.fit_language_model(docs)
    top = {r["doc_id"]: (r["lang"], r["p"]) for r in language.top_language(docs, model).collect()}
    for lang in ("en", "fr", "xx"):
        want = sorted(i for i, (l, p) in top.items() if l == lang and (above is None or p > above))
        kept = language.keep_language(docs, model, lang, above, budget=budget)
        assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns
        plan = kept._jdf.queryExecution().executedPlan().toString()
        if budget == 1 << 28:
            assert "Exchange" not in plan
        assert "SortMergeJoin" not in plan


def test_bounds_decide_most_rows(spark):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    rng = np.random.default_rng(1)
    stock = {l: [f"{l}{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(400)] for l in ("en", "fr")}
    rows = [(i, " ".join(rng.choice(stock[l], 60, p=np.arange(400, 0, -1) / 80200)), l) for i, l in enumerate(["en", "fr"] * 60)]
    rows += [(200 + i, " ".join([*rng.choice(stock["en"], 6), *rng.choice(stock["fr"], 6)]), None) for i in range(20)]
    docs = spark.createDataFrame(rows, StructType([StructField("doc_id", IntegerType()), StructField("text", StringType()), StructField("lang", StringType())]))
    model = language.fit_language_model(docs)
    weights = model.tokens.select("key", "n", *[F.ln(F.col(f"c{i}") + 1.0).alias(f"w{i}") for i in range(2)])
    split = lookup.split_weights(weights, 62_000)
    judge = language._Verdict(split.head.toArrow(), model, "en", 0.6, split.below)
    import pyarrow as pa

    found = judge.verdicts(*judge.sums(pa.array([tokens(t) for _, t, _ in rows])))
    assert split.tail.count() > 20 and (found[:120] >= 0).mean() > 0.8
    top = {r["doc_id"]: (r["lang"], r["p"]) for r in language.top_language(docs, model).collect()}
    for (i, _, _), v in zip(rows, found):
        assert v == -1 or v == (top[i][0] == "en" and top[i][1] > 0.6)


def test_language_model_survives_saving(spark, docs, tmp_path):
    model = language.fit_language_model(docs)
    model.save(str(tmp_path / "m"))
    loaded = language.load_language_model(spark, str(tmp_path / "m"))
    a, b = (sorted(language.language_scores(docs, m).collect()) for m in (model, loaded))
    assert a == b and loaded.vocabulary == model.vocabulary


def ngram_nll(order):
    texts = {i: tokens(t) for i, t, _ in DOCS}
    words = [t for ts in texts.values() for t in ts]
    vocabulary = len(set(words))
    single = Counter(words)
    pairs = Counter(p for ts in texts.values() for p in zip(["<s>"] + ts, ts))
    before = Counter(u for ts in texts.values() for u in (["<s>"] + ts)[: len(ts)])
    nll = {}
    for i, ts in texts.items():
        if ts and order == 1:
            nll[i] = -sum(math.log((single[t] + 1) / (len(words) + vocabulary)) for t in ts) / len(ts)
        elif ts:
            nll[i] = -sum(math.log((pairs[p] + 1) / (before[p[0]] + vocabulary)) for p in zip(["<s>"] + ts, ts)) / len(ts)
    return nll


@pytest.mark.parametrize("budget", [1 << 28, 150, 0])
@pytest.mark.parametrize("order", [1, 2])
def test_perplexity_equals_brute_force(docs, order, budget):
    model = (perplexity.fit_unigrams if order == 1 else perplexity.fit_bigrams)(docs)
    got = {r["doc_id"]: r for r in perplexity.perplexity(docs, model, budget=budget).collect()}
    want = ngram_nll(order)
    assert got.keys() == want.keys()
    for i, nll in want.items():
        assert got[i]["nll"] == pytest.approx(nll, abs=1e-12)
        assert got[i]["perplexity"] == pytest.approx(math.exp(nll))
        assert got[i]["quality"] == pytest.approx(1 / (1 + math.exp(nll)))
        assert got[i]["n_tokens"] == len(tokens(dict((d[0], d[1]) for d in DOCS)[i]))


def test_perplexity_of_unseen_text(spark, docs):
    other = spark.createDataFrame([(1, "quite new words")], "doc_id INT, text STRING")
    row = perplexity.perplexity(other, perplexity.fit_unigrams(docs)).first()
    words = [t for _, text, _ in DOCS for t in tokens(text)]
    assert row["nll"] == pytest.approx(math.log(len(words) + len(set(words))))


def test_boilerplate(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a/1", "menu\none\nmenu\nend"), (2, "http://a/2", "menu\ntwo"), (3, "http://b/1", "menu\nthree"),
            (4, "http://a/3", "menu"), (5, "http://c/1", "solo\nsolo"),
        ],
        "page_id INT, url STRING, text STRING",
    )
    assert [tuple(r) for r in boilerplate.host_boilerplate(pages).collect()] == [("a", "menu", 3)]
    got = {r["page_id"]: r["text"] for r in boilerplate.drop_boilerplate(pages).collect()}
    assert got == {1: "one\nend", 2: "two", 3: "menu\nthree", 5: "solo\nsolo"}
    assert boilerplate.drop_boilerplate(pages, min_pages=4).count() == 5


def test_mean_pool_with_and_without_mask(spark):
    rows = spark.createDataFrame(
        [("d", [1.0, 2.0], True), ("d", [3.0, 6.0], True), ("d", [0.0, 0.0], False), ("e", [5.0, 5.0], True)],
        "doc STRING, v ARRAY<FLOAT>, real BOOLEAN",
    )
    plain = {r["doc"]: r["embedding"] for r in pooling.mean_pool(rows, "doc", "v").collect()}
    np.testing.assert_allclose(plain["d"], [4 / 3, 8 / 3])
    masked = {r["doc"]: (r["embedding"], r["n"]) for r in pooling.mean_pool(rows, "doc", "v", F.col("real")).collect()}
    assert masked["d"] == ([2.0, 4.0], 2) and masked["e"] == ([5.0, 5.0], 1)


def vectors(spark, n=300, size=6):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, size))
    y = (x @ rng.normal(size=size) + rng.normal(size=n) * 0.3 > 0).astype(float)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)], "id INT, embedding ARRAY<DOUBLE>, label DOUBLE")
    return x, y, probe.vector_features(rows).cache()


def test_probe_equals_least_squares(spark, monkeypatch):
    x, y, rows = vectors(spark)
    want, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    for block in (256, 3):  # products in one block and in several
        monkeypatch.setattr(ridge, "BLOCK", block)
        model = probe.linear_probe(rows.repartition(7))
        np.testing.assert_allclose([*model.coefficients, model.intercept], want, atol=1e-10)
    scored = probe.score_corpus(rows, model).first()
    assert scored["score"] == pytest.approx(1 / (1 + math.exp(-scored["logit"])))


@pytest.mark.parametrize("size", [6, 40])
def test_grid_from_one_pass(spark, size):
    """Dependent features too: without penalty the fit of smallest norm."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, size))
    x[:, 1], x[:, 2] = 2 * x[:, 0], 0.5
    y = rng.normal(size=30)
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "features ARRAY<DOUBLE>, label DOUBLE")
    gap = x - x.mean(0)
    for found in probe.probe_grid(rows, (0.0, 0.1, 3.0)):
        if found.penalty:
            want = np.linalg.solve(gap.T @ gap / 30 + found.penalty * np.eye(size), gap.T @ (y - y.mean()) / 30)
        else:
            want = np.linalg.pinv(gap, rcond=1e-9) @ (y - y.mean())
        np.testing.assert_allclose(found.coefficients, want, atol=1e-8)
        np.testing.assert_allclose(found.intercept, y.mean() - x.mean(0) @ want, atol=1e-8)


def test_grid_of_odd_rows(spark):
    shape = "features ARRAY<DOUBLE>, label DOUBLE"
    rows = spark.createDataFrame([([1.0, 2.0], 1.0), (None, 1.0), ([5.0, 5.0], None)], shape)
    only = probe.linear_probe(rows)
    assert only.intercept == 1.0 and not only.coefficients.any()
    with pytest.raises(ValueError, match="no labelled rows"):
        probe.linear_probe(rows.limit(0), size=2)
    with pytest.raises(ValueError, match="features"):
        ridge.products(rows, 5000)


def test_best_probe_prefers_the_smaller_penalty_among_ties(spark):
    _, _, rows = vectors(spark)
    train, test = rows.where("id < 200"), rows.where("id >= 200")
    model, reg, found = probe.best_probe(train, test, grid=(1e-9, 0.0, 50.0))
    scores = {r["reg"]: r["f1_macro"] for r in found.collect()}
    assert reg == 0.0 and scores[0.0] == scores[1e-9] >= scores[50.0]
    decided = probe.decide(probe.with_logit(test, model)).select(F.col("label").cast("int").alias("label"), "pred")
    assert macro_metrics(decided).first()["f1_macro"] == pytest.approx(scores[0.0])


def test_text_probe_survives_saving(spark, docs, tmp_path):
    rows = docs.where("lang IS NOT NULL").withColumn("label", (F.col("lang") == "en").cast("double"))
    model = probe.text_probe(rows, size=64, penalty=0.1)
    probe.save_model(spark, model, str(tmp_path / "m"))
    a, b = (
        sorted(probe.score_corpus(docs, m).select("doc_id", "score").collect())
        for m in (model, probe.load_model(spark, str(tmp_path / "m")))
    )
    assert a == b and len(a) == len(DOCS)


def test_hashed_words(spark):
    texts = [(1, "The cat, the HAT"), (2, None), (3, ""), (4, "cat cat"), (5, "été 12")]
    rows = spark.createDataFrame(texts, "id INT, text STRING").repartition(3)
    made = probe.text_features(size=32).fit(rows)
    counts = {}
    for i, t in texts:
        own = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32 for w in tokens(t or ""))
        counts[i] = own
    seen = Counter(b for own in counts.values() for b in own)
    for r in made.transform(rows).collect():
        want = [(b, n * math.log(6 / (seen[b] + 1))) for b, n in sorted(counts[r["id"]].items())]
        assert r["features"]["at"] == [b for b, _ in want]
        np.testing.assert_allclose(r["features"]["x"], [x for _, x in want])


def test_truncation_is_an_option(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (2, "A b")], "id INT, text STRING")

    def used(**options):
        made = probe.text_features(size=1 << 16, **options).fit(rows).transform(rows.union(rows)).orderBy("id").collect()
        return len(made[0]["features"]["at"]), len(made[-1]["features"]["at"])

    assert used() == (4, 2) and used(max_tokens=2) == (2, 2)
    assert probe.text_features().fit(rows).transform(rows).columns == ["id", "text", "features"]


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_domains_by_centroid(spark, block):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.8, 0.2], "x"), (3, [0.0, 1.0], "y")], "id INT, embedding ARRAY<FLOAT>, label STRING")
    centroids = pooling.mean_pool(rows, "label", "embedding")
    got = probe.centroid_domains(rows, centroids, "id", block_bytes=block).orderBy("id").collect()
    assert [r["domain"] for r in got] == ["x", "x", "y"]
    assert got[0]["p"] == pytest.approx(math.exp(0.9) / (math.exp(0.9) + 1))
    assert probe.centroid_domains(rows, centroids.limit(0), "id").count() == 0


def test_thousands_of_domains(spark):
    """More classes than one block holds, against a plain softmax; ties by name."""
    rng = np.random.default_rng(5)
    classes, points = rng.normal(size=(5000, 8)), rng.normal(size=(40, 8))
    points[0], classes[3] = 5 * classes[3], 3 * classes[3]
    classes[17] = classes[3]
    centroids = spark.createDataFrame([(f"c{i:04d}", [float(v) for v in c]) for i, c in enumerate(classes)], "label STRING, embedding ARRAY<DOUBLE>")
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "vec_id INT, embedding ARRAY<DOUBLE>")
    sims = points @ classes.T
    share = np.exp(sims - sims.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    for r in probe.centroid_domains(rows, centroids, block_bytes=64_000).collect():
        i = r["vec_id"]
        assert r["domain"] == f"c{sims[i].argmax():04d}" and r["p"] == pytest.approx(share[i].max())
    assert sims[0].argmax() == 3


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_rare_keys_travel_in_blocks(spark, capsys, kind):
    rows = [(1, "a"), (1, "a"), (1, "zz"), (2, "b"), (None, "b"), (None, "c"), (2, None), (1, "a"), (3, "new"), (3, "b")]
    rows = [(r if r is None or kind == "BIGINT" else str(r), k, "b") for r, k in rows]
    given = {"a": (9, 1.5, 0.25), "b": (2, 0.5, 4.0), "c": (1, 0.125, 8.0)}
    occurrences = spark.createDataFrame(rows, f"row {kind}, key STRING, other STRING").coalesce(1)
    weights = spark.createDataFrame([(k, *v) for k, v in given.items()], "key STRING, n BIGINT, w DOUBLE, x DOUBLE")
    want = {}
    for row, key, other in rows:
        n, w, x = want.get(row, (0, 0.0, 0.0))
        for k in (key, other):
            w, x = (w + given[k][1], x + given[k][2]) if k in given else (w, x)
        want[row] = n + 1, w, x
    for budget in (0, 100, 1 << 20):  # no head, a part, no tail
        found = lookup.lookup_sums(occurrences, "row", weights, budget, ("key", "other"))
        assert found.columns == ["row", "n", "w", "x"]
        assert {r["row"]: (r["n"], r["w"], r["x"]) for r in found.collect()} == want
        assert not re.search(r"hashpartitioning\([^)]*key#", _plan(found, capsys))


def test_bigrams_are_counted_in_blocks(spark, capsys, monkeypatch):
    from gleaner.operators import packing

    rows = [(i, "a b a b c" if i % 2 else "a b " * 40) for i in range(60)] + [(None, None), (7, "")]
    made = spark.createDataFrame(rows, "doc_id INT, text STRING")
    keys = perplexity._pairs(made, "text").select("key")
    found = packing.counted(keys, 3)
    assert {r["key"]: r["n"] for r in found.collect()} == {r["key"]: r["n"] for r in perplexity._count(keys).collect()}
    assert not re.search(r"hashpartitioning\([^)]*key#", _plan(found, capsys))
    monkeypatch.setattr(packing, "BLOCK_ROWS", 50)
    assert sum(t.num_rows for t in packing.stretches(keys.toArrow().to_batches(max_chunksize=20), 50)) == keys.count()
