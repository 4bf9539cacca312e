import pytest
from pyspark.sql import functions as F

from gleaner import __main__ as command
from gleaner.operators import probe
from tests.test_jobs import folders  # noqa: F401


def test_clean_warcs(spark, folders, tmp_path, capsys):  # noqa: F811
    docs = [("the cat and the dog sat on the mat", "en"), ("le chat et le chien sont dans la maison", "fr")]
    spark.createDataFrame(docs, "text STRING, lang STRING").write.parquet(str(tmp_path / "docs"))
    command.main(["fit-language", "--labelled", str(tmp_path / "docs"), "--model", str(tmp_path / "lid")])
    (tmp_path / "paths").write_text("x/none.warc.gz\nx/a.warc.gz\n")
    shared = ["--blocklist", str(folders / "lists"), "--model", str(tmp_path / "lid")]
    command.main(["clean-warcs", "--warcs", str(folders / "warc"), "--list", str(tmp_path / "paths"), "--out", str(tmp_path / "clean")] + shared)
    said = capsys.readouterr().out
    assert "not there: 1" in said and "none.warc.gz" in said
    got = spark.read.parquet(str(tmp_path / "clean")).collect()
    assert [(r["url"], r["warc_file"]) for r in got] == [("http://ok.example/en", "a")] * 2
    command.main(["clean-warcs", "--warcs", str(folders / "warc"), "--csv", "--out", str(tmp_path / "csv")] + shared)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True).count() == 2


def test_links_and_picks(spark, tmp_path, capsys):
    (tmp_path / "api").mkdir()
    (tmp_path / "api" / "1.json").write_text('{"query":{"pages":{"1":{"title":"A","extlinks":[{"*":"http://s/0"},{"*":"http://o/"}]}}}}')
    command.main(["extract-links", "--responses", str(tmp_path / "api"), "--out", str(tmp_path / "links")])
    assert "distinct external links: 2" in capsys.readouterr().out
    (tmp_path / "index").write_text("".join(f'k 1 {{"url":"http://s/{i}","filename":"f","languages":"eng"}}\n' for i in range(5)))
    command.main(["pick-urls", "--index", str(tmp_path / "index"), "--links", str(tmp_path / "links"), "--out", str(tmp_path / "picks")])
    got = {r["url"] for r in spark.read.parquet(str(tmp_path / "picks")).collect()}
    assert len(got) == 2 and "http://s/0" not in got


def test_train(spark, tmp_path, capsys):
    for name, text in (("good", "fine careful prose"), ("bad", "spam spam buy")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.txt").write_text("".join(f"{text} {'abcdefghij'[i % 10] * (i // 10 + 1)}\n" for i in range(60)))
    command.main(["train", "--good", str(tmp_path / "good"), "--bad", str(tmp_path / "bad"), "--model", str(tmp_path / "m"), "--rows", "50", "--features", "64"])
    assert "accuracy" in capsys.readouterr().out
    texts = spark.createDataFrame([("fine careful prose",), ("spam buy",)], "text STRING")
    good, bad = (r["score"] for r in probe.score_corpus(texts, probe.load_model(spark, str(tmp_path / "m"))).collect())
    assert good > bad


def test_rerank_runs(spark, tmp_path, capsys):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.rand(0).alias("q_m"))
    rows.write.parquet(str(tmp_path / "c"))
    rows.where("doc_id < 4").select(F.col("doc_id").alias("query_id"), "embedding", F.lit("t").alias("task")).write.parquet(str(tmp_path / "q"))
    spark.createDataFrame([(i, i, 1) for i in range(4)], "query_id LONG, doc_id LONG, rel INT").write.parquet(str(tmp_path / "r"))
    command.main(
        ["rerank-runs", "--queries", str(tmp_path / "q"), "--corpus", str(tmp_path / "c"), "--relevant", str(tmp_path / "r"), "--out", str(tmp_path / "o")]
    )
    assert "ndcg" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4 * 40 * 4


def test_unknown_job():
    with pytest.raises(SystemExit):
        command.main(["nothing"])
