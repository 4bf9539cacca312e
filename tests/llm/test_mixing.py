"""Source mixing against its SQL and its own definition."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing

WORD = re.compile(r"[^\x20\t-\r]+")


def targets_by_rounds(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_plan(docs, rows):
    plan = mixing.mix_plan(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_by_rounds(dict(sizes))
    assert len(plan) == len(rows)
    by_size = {v: want[s] for s, v in sizes.items()}
    for r in plan:
        assert r["target"] == pytest.approx(by_size[r["source_size"]])
        assert 0 <= r["copies"] <= 3
        if r["source_size"]:
            rate = r["target"] / r["source_size"]
            assert int(rate) <= r["copies"] <= int(rate) + 1
        else:
            assert r["copies"] == 0
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_mix_emits_the_plan(docs, no_docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {(r["doc_id"]): r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    plan = mixing.mix_plan(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert times == {r["doc_id"]: r["n"] for r in plan if r["n"]}
    assert mixing.mix(no_docs).count() == 0 and mixing.mix_plan(no_docs).count() == 0


def test_taken_words_come_near_the_target(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit("a b c").alias("text")
    )
    taken = F.sum(F.col("size") * F.col("copies")).alias("taken")
    plan = mixing.mix_plan(rows).groupBy((F.col("doc_id") % 4).alias("s")).agg(taken, F.first("target").alias("target"))
    for r in plan.collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.05)
