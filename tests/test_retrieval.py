import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import retrieval
from gleaner.plans import rerank_eval


def vectors(spark, n, seed, name, kind="BIGINT", tasks=4, copies=()):
    x = np.random.default_rng(seed).normal(size=(n, 8)).round(3)
    for a, b in copies:
        x[a] = x[b]
    make = (lambda i: i) if kind == "BIGINT" else (lambda i: f"d{i:04d}")
    rows = [(make(i), [float(v) for v in x[i]]) for i in range(n)]
    return x, spark.createDataFrame(rows, f"{name} {kind}, embedding ARRAY<DOUBLE>").repartition(tasks)


def brute(q, c, k, make=lambda i: i):
    sims = np.round(q @ c.T, 12)
    return {(i, make(j), r + 1) for i in range(len(q)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-sims[i, j], j))[:k])}


def ranks(df):
    return {(r["query_id"], r["doc_id"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
@pytest.mark.parametrize("k", [1, 10, 500])
def test_topk_equals_brute_force_with_ties(spark, k, kind):
    q, queries = vectors(spark, 9, 1, "query_id")
    c, corpus = vectors(spark, 300, 2, "doc_id", kind, copies=[(7, 250), (8, 250), (200, 3)])
    make = (lambda i: i) if kind == "BIGINT" else (lambda i: f"d{i:04d}")
    assert ranks(retrieval.dense_topk(queries, corpus, k)) == brute(q, c, k, make)


@pytest.mark.parametrize("option", [{"query_bytes": 300}, {"prescan": 0.3}, {"prescan": 0.001}])
def test_blocks_and_prescan_change_nothing(spark, option):
    q, queries = vectors(spark, 23, 3, "query_id")
    c, corpus = vectors(spark, 400, 4, "doc_id", tasks=8)
    assert ranks(retrieval.dense_topk(queries, corpus, 5, **option)) == brute(q, c, 5)


def test_cosine_ignores_lengths(spark):
    q, queries = vectors(spark, 9, 1, "query_id")
    c, corpus = vectors(spark, 300, 2, "doc_id", copies=[(7, 250)])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert ranks(retrieval.dense_topk(queries, corpus, 10, metric="cosine")) == brute(unit(q), unit(c), 10)
    with pytest.raises(ValueError):
        retrieval.dense_topk(queries, corpus, 10, metric="euclid")


def test_missing_and_ragged_vectors(spark):
    q, queries = vectors(spark, 3, 1, "query_id")
    c, corpus = vectors(spark, 30, 2, "doc_id")
    nothing = spark.createDataFrame([(99, None)], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    assert ranks(retrieval.dense_topk(queries.union(nothing), corpus, 4)) == brute(q, c, 4)
    short = spark.createDataFrame([(99, [1.0])], "doc_id BIGINT, embedding ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="lengths"):
        retrieval.dense_topk(queries, corpus.union(short), 4)


def test_small_batches_and_empty_sides(spark):
    q, queries = vectors(spark, 5, 5, "query_id")
    c, corpus = vectors(spark, 100, 6, "doc_id", tasks=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert ranks(retrieval.dense_topk(queries, corpus, 9)) == brute(q, c, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert retrieval.dense_topk(queries.limit(0), corpus, 3).count() == 0
    assert retrieval.dense_topk(queries, corpus.limit(0), 3).count() == 0


def run_of(spark, rows):
    return spark.createDataFrame(rows, "query_id INT, doc_id INT, sim DOUBLE, quality DOUBLE")


def test_normalise_and_rerank(spark):
    run = run_of(spark, [(1, 1, 0.9, 0.2), (1, 2, 0.8, 0.6), (1, 3, 0.7, 0.4), (2, 1, 0.5, 0.3), (2, 2, 0.5, 0.3)])
    scaled = retrieval.normalise_quality(run)
    got = {(r["query_id"], r["doc_id"]): r["quality"] for r in scaled.collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): pytest.approx(0.5), (2, 1): 0.0, (2, 2): 0.0}
    order = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.rerank(scaled, 0.5).collect()}
    assert [order[1, r] for r in (1, 2, 3)] == [2, 3, 1] and [order[2, r] for r in (1, 2)] == [1, 2]
    control = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.rerank(scaled, 1.0, cut=2).collect()}
    assert control == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 2}
    with pytest.raises(ValueError):
        retrieval.normalise_quality(run, "other")


def test_topk_mean_mode(spark):
    run = spark.createDataFrame([(1, 1, [0.5, 0.3, 0.2, 0.0])], "query_id INT, doc_id INT, quality ARRAY<DOUBLE>")
    assert retrieval.normalise_quality(run, "topk_mean").first()["quality"] == pytest.approx(1 / 3)


def test_metrics_by_hand(spark):
    run = spark.createDataFrame(
        [(1, d, r) for r, d in enumerate([5, 3, 9, 7], 1)] + [(2, d, r) for r, d in enumerate([1, 2], 1)] + [(3, 8, 1)],
        "query_id INT, doc_id INT, rank INT",
    )
    relevant = spark.createDataFrame([(1, 3, 1), (1, 7, 2), (1, 100, 1), (2, 50, 1), (3, 8, 0)], "query_id INT, doc_id INT, rel INT")
    got = retrieval.ranking_metrics(retrieval.judge(run, relevant), 10).first()
    dcg = 1 / math.log2(3) + 1 / math.log2(5)
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert got["n_queries"] == 2  # query 3 has no relevant document
    assert got["ndcg"] == pytest.approx(dcg / ideal / 2)
    assert got["map"] == pytest.approx((1 / 2 + 2 / 4) / 3 / 2)
    assert got["recall"] == pytest.approx(2 / 3 / 2)
    assert got["precision"] == pytest.approx(0.2 / 2)
    assert got["mrr"] == pytest.approx(0.5 / 2)


def test_sweep_covers_the_grid(spark):
    rows = [(q, d, 1.0 - d / 10, d % 3 / 2, q % 2, int(d == 2), 1) for q in range(4) for d in range(6)]
    run = spark.createDataFrame(rows, "query_id INT, doc_id INT, sim DOUBLE, q DOUBLE, task INT, rel INT, n_relevant INT")
    models = {"plain": F.col("q"), "inverse": 1 - F.col("q")}
    got = rerank_eval.evaluate(run, models, [0.5, 1.0]).collect()
    assert len(got) == 8 and {r["n_queries"] for r in got} == {2}
    control = [r["mrr"] for r in got if r["quality_p"] == 1.0]
    assert control == pytest.approx([1 / 3] * 4)
    assert all(r["mrr"] == pytest.approx(1.0) for r in got if r["quality_p"] == 0.5 and r["model"] == "plain")
