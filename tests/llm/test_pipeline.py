"""The pipeline against its operators, stage by stage, and the registered queries."""

import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from gleaner.llm import mixing, queries, sql
from gleaner.llm.bytelevel import read_ranks
from gleaner.runtime import materialise

from .test_dedup import alike_groups
from .test_models import exact_spans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(sql.statements()[name]).to_arrow_table()
    got = queries.REGISTRY[name](spark, FOLDER).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    order = sorted(got.column_names)
    assert sorted(map(repr, got.select(order).to_pylist())) == sorted(map(repr, want.select(order).to_pylist()))


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.REGISTRY} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "personal_data", "source_mix", "byte_bpe"]


def test_stages_one_by_one(spark):
    """Each stage on its own input, checked without its operator."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def after(name, before):
        return materialise(stage[name](spark, before, FOLDER), name)

    good = after("quality_rules", docs)
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    failed = {r["doc_id"] for r in queries.REGISTRY["op7_robust_outliers"](spark, FOLDER).where("base_failed").collect()}
    assert not kept & failed
    assert all(d in kept or d in failed for d, q in labels.items() if q == 1)

    single = after("near_copies", good)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    least = alike_groups(rows, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(least.values()))

    masked = after("personal_data", single)
    for r in masked.collect():
        assert not any(exact_spans(r["text"]).values()) and r["n_chars"] == len(r["text"])

    mixed = after("source_mix", masked)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(masked).collect()}
    seen = [r["doc_id"] for r in mixed.collect()]
    assert sorted(seen) == sorted(d for d, n in plan.items() for _ in range(n))

    ids = after("byte_bpe", mixed)
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}
    )
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in ids.collect():
        assert r["n_tokens"] == len(own.encode_ordinary(texts[r["doc_id"]])) == len(r["ids"]) // 4


def test_near_copies_share_five_word_shingles(spark):
    """The stage takes 0.8 of five-word sets: one changed word of 51 is a near copy
    (42 of 52 sets of five, 44 of 52 sets of four); one of 46 is not."""
    rows = []
    for i, n in enumerate((51, 46, 60, 200)):
        base = [f"t{i}w{j}" for j in range(n)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join([*base[: n // 2], "changed", *base[n // 2 + 1 :]]))]
    want = alike_groups(rows, 5, 80)
    assert want[1] == 0 and want[11] == 11 and alike_groups(rows, 4, 85)[1] == 1
    full = [(k, t, "en", "a", len(t)) for k, t in rows]
    docs = spark.createDataFrame(full, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    found = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(want.values()))


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and found.count() > 50


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, FOLDER), "empty")
        assert docs.count() == 0


def test_workers_give_memory_back():
    import os

    import numpy as np

    from gleaner.llm.words import thrifty

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    kept = []

    def run(batches):
        for n in batches:
            held = [np.ones(12_000, np.uint8) for _ in range(n)]
            kept.append(held[-1])  # the end of the heap stays in use
            yield len(held)

    before = resident()
    assert list(thrifty(run)([20_000])) == [20_000]
    assert resident() - before < 60  # of 240


def test_personal_data_in_bounded_parts(spark, monkeypatch):
    from gleaner.llm import pii, words

    rows = [(i, f"mail a{i}@b.org " + "word " * 50) for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING").coalesce(1)
    sizes = []

    def small(batch, text):
        for part in words.slices(batch, text, 1000):
            sizes.append(part.num_rows)
            yield part

    want = {i: t and t.replace(f"a{i}@b.org", "<email>") for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()} == want
    monkeypatch.setattr(pii, "slices", small)
    run = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f) or self.limit(0))
    pii.found_spans(docs)
    assert len(list(run[0](docs.toArrow().to_batches()))) == len(sizes) > 5
