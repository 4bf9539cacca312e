import pytest
from pyspark.sql import functions as F

from gleaner.operators import ids, links, membership


def urls_of(df, name="url"):
    return sorted([r[name] for r in df.collect()], key=str)


@pytest.mark.parametrize("limit", [1 << 20, 200, 0])
def test_anti_join_is_the_same_however_it_runs(spark, limit):
    """Broadcast, reduced broadcast and shuffle join; duplicates and NULL stay."""
    left = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "url STRING")
    keys = spark.createDataFrame([("b",), ("b",), (None,)] + [(f"x{i}",) for i in range(50)], "url STRING")
    assert urls_of(membership.anti_join(left, keys, "url", limit)) == [None, "a", "a", "c"]


def test_large_key_sets_do_not_broadcast(spark):
    left = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"))
    plan = membership.anti_join(left, left, "url", limit=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_hot_key_on_the_left(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"))
    keys = spark.createDataFrame([("hot",), ("1",)], "url STRING")
    for limit in (1 << 20, 0):
        assert membership.anti_join(left, keys, "url", limit).count() == 19_999


@pytest.fixture
def pages(spark):
    rows = [
        (1, "http://bad.example/x"), (2, "http://sub.bad.example/x"), (3, "http://BAD.example/x"),
        (4, "http://bad.example:80/x"), (5, "http://ok.example/u"), (6, "http://ok.example/v"), (7, None),
    ]
    return spark.createDataFrame(rows, "page_id INT, url STRING")


def test_blocklist_matches_the_authority_as_it_stands(spark, pages):
    domains = spark.createDataFrame([("bad.example",)], "domain STRING")
    blocked = spark.createDataFrame([("http://ok.example/u",)], "url STRING")
    kept = membership.drop_blocked(pages, domains, blocked)
    assert sorted(r["page_id"] for r in kept.collect()) == [2, 3, 4, 6, 7]
    kept = membership.drop_blocked(pages, domains, blocked, match_parents=True)
    assert sorted(r["page_id"] for r in kept.collect()) == [6, 7]


def test_mark_member(spark, pages):
    keys = spark.createDataFrame([("http://ok.example/u",)] * 2, "url STRING")
    marked = membership.mark_member(pages, keys, "url", "hit").collect()
    assert len(marked) == 7 and [r["page_id"] for r in marked if r["hit"]] == [5]


def test_stage_counts(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "i INT, ok BOOLEAN")
    got = membership.stage_counts(rows, {"all": F.lit(True), "ok": F.col("ok"), "big": F.col("i") > 3})
    assert [(r["stage"], r["n"]) for r in got.orderBy("step").collect()] == [("all", 4), ("ok", 2), ("big", 1)]


def test_link_stats_count_a_blank_line_once(spark):
    lines = spark.createDataFrame([(" a",), ("a\t",), ("",), (" ",), ("b",)], "value STRING")
    assert tuple(links.link_stats(lines).first()) == (5, 3)
    assert tuple(links.link_stats(lines, approximate=True).first()) == (5, 3)
    assert tuple(links.link_stats(lines.limit(0)).first()) == (0, 0)
    assert links.distinct_links(lines).count() == 3


@pytest.mark.parametrize("tasks", [1, 7])
def test_ids_are_consecutive_in_key_order(spark, tasks):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit("x").alias("v")).repartition(tasks)
    got = ids.sequential_ids(rows, "k").orderBy("k").collect()
    assert [(r["k"], r["seq"]) for r in got] == [(i, i) for i in range(500)]
    kept = ids.sequential_ids(rows, "k", keep=F.col("k") % 2 == 1).orderBy("k").collect()
    assert [(r["k"], r["seq"]) for r in kept] == [(2 * i + 1, i) for i in range(250)]
    assert ids.sequential_ids(rows.limit(0), "k").count() == 0
