import hashlib

import pytest
from pyspark.sql import functions as F

from gleaner.operators import sampling


def md5(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def table(spark, n=1000, tasks=4):
    return spark.range(n).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label")).repartition(tasks)


@pytest.mark.parametrize("fine_rows", [50_000, 0])
@pytest.mark.parametrize("n", [0, 1, 7, 99, 100, 101, 950, 1000, 5000])
def test_exact_sample_equals_the_direct_cut(spark, monkeypatch, n, fine_rows):
    monkeypatch.setattr(sampling, "FINE_ROWS", fine_rows)
    got = sampling.exact_sample(table(spark), n, "id", by="label").collect()
    want = set()
    for label in (0, 1):
        members = [i for i in range(1000) if (i % 10 == 0) == label]
        want |= {(i, label) for i in sorted(members, key=md5)[:n]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_sample_does_not_depend_on_partitions_or_columns(spark):
    one = sampling.exact_sample(table(spark, tasks=1), 50, "id").collect()
    many = sampling.exact_sample(table(spark, tasks=8).withColumn("wide", F.lit("x")), 50, "id").select("id", "label").collect()
    assert sorted(one) == sorted(many)
    assert {r["id"] for r in one} == set(sorted(range(1000), key=md5)[:50])
    other = sampling.exact_sample(table(spark), 50, "id", seed=1).collect()
    assert {r["id"] for r in other} == set(sorted(range(1000), key=lambda i: md5(i, 1))[:50])


@pytest.mark.parametrize("fine_rows", [50_000, 0])
@pytest.mark.parametrize("n", [1, 10, 37, 10_000])
def test_copies_are_taken_in_order(spark, monkeypatch, n, fine_rows):
    monkeypatch.setattr(sampling, "FINE_ROWS", fine_rows)
    rows = spark.range(40).select("id", (F.col("id") % 5 + 1).alias("copies"))
    got = {r["id"]: r["copies"] for r in sampling.exact_sample(rows, n, "id", copies="copies").collect()}
    left, want = n, {}
    for i in sorted(range(40), key=md5):
        if left > 0:
            want[i] = min(left, i % 5 + 1)
            left -= want[i]
    assert got == want


def test_null_class_is_a_class(spark):
    rows = spark.createDataFrame([(i, None if i < 20 else "a") for i in range(40)], "id INT, label STRING")
    got = sampling.exact_sample(rows, 5, "id", by="label").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {None: 5, "a": 5}


def test_crawl_pick_with_a_hot_entry(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"), F.lit("f").alias("filename")
    )
    assert sampling.crawl_pick(rows, 0).count() == 0
    assert sampling.crawl_pick(rows, 5000).count() == 900
    keys = {"hot": 300} | {str(i): 1 for i in range(900) if i % 3}
    ordered = [u for u in sorted(keys, key=lambda u: md5(f"{u} f")) for _ in range(keys[u])]
    for quota in (1, 450, 899):
        got = sorted(r["url"] for r in sampling.crawl_pick(rows, quota).collect())
        assert got == sorted(ordered[:quota])


def test_copies_are_written_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPY_BLOCK", 7)
    rows = spark.createDataFrame([("a", 1), ("b", 7), ("c", 8), ("d", 700)], "k STRING, copies LONG")
    got = sampling.write_out_copies(rows).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 1, "b": 7, "c": 8, "d": 700}


@pytest.mark.parametrize("n", [0, 1, 20, 500, 2000])
def test_head_n(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "HEAP_ROWS", 100)
    got = sampling.head_n(table(spark), n, "id").collect()
    assert [r["id"] for r in got] == list(range(min(n, 1000)))


@pytest.mark.parametrize("heap", [2, 100])
def test_head_n_leaves_null_keys_out(spark, monkeypatch, heap):
    monkeypatch.setattr(sampling, "HEAP_ROWS", heap)
    rows = spark.createDataFrame([(3,), (None,), (1,), (None,), (2,)], "id INT")
    assert [r["id"] for r in sampling.head_n(rows, 3, "id").collect()] == [1, 2, 3]


def test_balanced_negatives(spark):
    good = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "title STRING")
    pool = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "x", "x", "y", "z", "w", "b"])], "doc_id INT, title STRING")
    got = sampling.balanced_negatives(pool, good).collect()
    assert {r["title"] for r in got} == set(sorted("xyzw", key=md5)[:3])
    assert all(r["doc_id"] == {"x": 1, "y": 3, "z": 4, "w": 5}[r["title"]] for r in got)


def test_shuffle_split_and_union(spark):
    rows = table(spark)
    order = [r["id"] for r in sampling.seeded_shuffle(rows, "id").collect()]
    assert order == sorted(range(1000), key=md5)
    places = {r["id"]: r["position"] for r in sampling.shuffled_position(rows, "id").collect()}
    assert places == {i: p for p, i in enumerate(order)}
    split = sampling.train_test_split(rows, "id").collect()
    assert {r["id"] for r in split if r["split"] == "test"} == {i for i in range(1000) if int(md5(f"split:{i}")[:8], 16) / 2**32 < 0.2}
    # A sample is split like any other table.
    part = sampling.train_test_split(sampling.exact_sample(spark.range(20_000), 1000, "id"), "id")
    assert 150 < part.where("split = 'test'").count() < 250
    exact = sampling.exact_train_test_split(rows, "id", 200).collect()
    assert {r["id"] for r in exact if r["split"] == "test"} == set(order[:200]) and len(exact) == 1000
    assert sampling.labelled_union([rows, rows.select("label", "id")]).count() == 2000
