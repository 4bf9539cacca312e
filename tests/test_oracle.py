"""Every registered query against its SQL on the smallest tables, and the shape
of its plan."""

import re

import pytest

import __spark_entry__ as entry
from check import canonical, connect
from gleaner.operators import language, sampling
from registry import fixtures

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = [name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_names():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "CollectLimit"):
        assert slow not in plan
    table = frame.toArrow()
    if name not in SQL:
        assert table.num_rows > 0
        return
    expected = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(table.column_names) == sorted(expected.column_names)
    assert canonical(table.to_pylist()) == canonical(expected.to_pylist())
    types = [{c: str(t.schema.field(c).type) for c in t.column_names} for t in (table, expected)]
    assert types[0] == types[1]


def test_languages_of_unseen_documents(spark):
    rows = fixtures.documents(spark, "/root/testdata/sf0.01", "doc_id", "text", "lang")
    split = sampling.train_test_split(rows, "doc_id")
    model = language.fit_language_model(split.where("split = 'train'"))
    held_out = split.where("split = 'test'")
    top = language.top_language(held_out, model).withColumnRenamed("lang", "found")
    found = held_out.join(top, "doc_id").selectExpr("count(*) AS n", "count_if(lang = found) AS good").first()
    assert found["n"] > 150 and found["good"] == found["n"]


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["url", "text"] and frame.count() > 0


def test_scans_read_only_what_is_used(spark):
    plan = entry.queries()["train_test_split"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_extraction_runs_once_per_row(spark):
    plan = entry.entry(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<(?:script") == 1
