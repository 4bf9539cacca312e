import gzip

import pytest
from pyspark.sql import functions as F

from gleaner.operators import language
from gleaner.plans import clean_pages, crawl_picks, train_probe
from gleaner.runtime import clear_scratch, fits_broadcast, materialise, scratch_root, session
from gleaner.sources import blocklist, crawl_index, warc
from gleaner.streaming import ingest

HTTP = "HTTP/1.1 200 OK\r\n\r\n"


def write_warc(path, pages):
    with gzip.open(path, "wb") as f:
        for url, html in pages:
            payload = (HTTP + html).encode()
            f.write(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(payload)}\r\n\r\n".encode())
            f.write(payload + b"\r\n\r\n")


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "lists" / "ads").mkdir(parents=True)
    (tmp_path / "lists" / "ads" / "domains").write_text("ads.example\n")
    (tmp_path / "warc").mkdir()
    write_warc(
        tmp_path / "warc" / "a.warc.gz",
        [
            ("http://ads.example/x", "<p>the cat and the dog</p>"),
            ("http://ok.example/en", "<nav>menu</nav><p>the cat</p><p>and the dog</p>"),
            ("http://ok.example/en", "<nav>menu</nav><p>the cat</p><p>and the dog</p>"),
            ("http://ok.example/fr", "<p>le chat et le chien</p>"),
            ("http://ok.example/none", "<script>x</script>"),
        ],
    )
    return tmp_path


@pytest.fixture
def model(spark):
    docs = [("the cat and the dog sat on the mat", "en"), ("le chat et le chien sont dans la maison", "fr")]
    return language.fit_language_model(spark.createDataFrame(docs, "text STRING, lang STRING"))


def test_warc_files_to_clean_pages(spark, folders, model):
    records = warc.read_warc(spark, str(folders / "warc"))
    listed = blocklist.read_blocklist(spark, str(folders / "lists"))
    got = clean_pages.clean_warc(records, listed, model)
    assert set(got.columns) == {"url", "text", "warc_file"}
    # A page recorded twice stays twice.
    assert [(r["url"], r["text"]) for r in got.collect()] == [("http://ok.example/en", "the cat\nand the dog")] * 2
    known = spark.createDataFrame([("http://ok.example/en",)], "url STRING")
    assert clean_pages.clean_warc(records, listed, model, curated_urls=known).count() == 0


def test_streams_take_each_file_once(spark, folders):
    listed = materialise(blocklist.read_blocklist(spark, str(folders / "lists")), "lists")
    out, checkpoint = str(folders / "out"), str(folders / "checkpoint")

    def run():
        ingest.ingest(ingest.warc_stream(spark, str(folders / "warc")), listed, out, checkpoint)
        return sorted(r["url"] for r in spark.read.parquet(out).collect())

    first = ["http://ok.example/en"] * 2 + ["http://ok.example/fr"]
    assert run() == first
    assert run() == first
    write_warc(folders / "warc" / "b.warc.gz", [("http://new.example/", "<p>new page</p>")])
    assert run() == ["http://new.example/"] + first


def test_stream_with_language_filter(spark, folders, model):
    listed = materialise(blocklist.read_blocklist(spark, str(folders / "lists")), "lists")

    def run():
        pages = ingest.warc_stream(spark, str(folders / "warc"))
        ingest.ingest_clean(pages, listed, model, str(folders / "out"), str(folders / "checkpoint"))
        return sorted(r["url"] for r in spark.read.parquet(str(folders / "out")).collect())

    assert run() == run() == ["http://ok.example/en"] * 2
    write_warc(folders / "warc" / "b.warc.gz", [("http://new.example/", "<p>the mat</p>"), ("http://fr/", "<p>la maison</p>")])
    assert run() == ["http://new.example/"] + ["http://ok.example/en"] * 2


def test_index_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "cdx.gz", "wt") as f:
        f.write('k 1 {"url":"http://a/","filename":"f","languages":"eng"}\nbroken\nk 1 {"url":"http://b/","filename":"f"}\n')
    entries = crawl_index.english_entries(crawl_index.parse_index(spark.readStream.text(str(tmp_path / "in"))))
    query = entries.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("http://a/", "f")]


def test_boilerplate_is_dropped_on_request(spark, folders, model):
    write_warc(
        folders / "warc" / "c.warc.gz",
        [(f"http://many.example/{i}", f"<p>the dog {'x' * (i + 1)}</p><p>the cat on the mat</p>") for i in range(3)],
    )
    records = warc.read_warc(spark, str(folders / "warc" / "c.warc.gz"))
    listed = blocklist.read_blocklist(spark, str(folders / "lists"))
    kept = clean_pages.clean_warc(records, listed, model, above=0.0, min_pages=3)
    assert sorted(r["text"] for r in kept.collect()) == ["the dog x", "the dog xx", "the dog xxx"]


def test_pick_crawl_urls(spark):
    index = [f'k 1 {{"url":"http://s/{i}","filename":"f{i}","languages":"eng"}}' for i in range(9)]
    index += ['k 1 {"url":"http://s/fr","filename":"f","languages":"fra"}', "broken"]
    links = ["http://s/0", "http://s/0 ", "http://s/1", "http://other/"]
    frames = [spark.createDataFrame([(v,) for v in rows], "value STRING") for rows in (index, links)]
    got = crawl_picks.pick_crawl_urls(*frames).collect()
    assert len(got) == 3 and not {r["url"] for r in got} & {"http://s/0", "http://s/1", "http://s/fr"}
    assert crawl_picks.pick_crawl_urls(frames[0], frames[1].limit(0)).count() == 0


def test_training_separates_good_from_bad(spark):
    good = spark.range(60).select(F.concat(F.lit("g"), "id").alias("key"), F.lit("fine careful prose").alias("text"))
    bad = spark.range(60).select(F.concat(F.lit("b"), "id").alias("key"), F.lit("spam spam buy").alias("text"))
    sample = train_probe.labelled_sample(good, bad, "key", 50)
    assert {(r["label"], r["count"]) for r in sample.groupBy("label").count().collect()} == {(0.0, 50), (1.0, 50)}
    trained = train_probe.train_quality_probe(sample, size=64, grid=(0.01, 0.1))
    assert trained.reg == 0.01
    accuracy = [r["f1"] for r in trained.report.collect() if r["name"] == "accuracy"]
    assert accuracy == [1.0]
    assert trained.model.transform(good.limit(1)).first()["logit"] > 0.5


def test_sampled_copies_stay_together(spark):
    rows = [
        spark.createDataFrame([(f"{side}{i}", f"{side} {i}", 3) for i in range(30)], "key STRING, text STRING, copies LONG")
        for side in "gb"
    ]
    sample = train_probe.labelled_sample(*rows, "key", 40, copies="copies").collect()
    assert len(sample) == 80 and sum(r["label"] for r in sample) == 40
    assert len({(r["key"], r["split"]) for r in sample}) == len({r["key"] for r in sample})


def test_scratch(spark):
    table = materialise(spark.range(5), "t")
    assert table.count() == 5 and scratch_root(spark).endswith(spark.sparkContext.applicationId)
    assert fits_broadcast(table, 5 * 80) and not fits_broadcast(table, 5 * 80 - 1)
    clear_scratch(spark)
    with pytest.raises(Exception):
        table.count()


def test_ingest_refuses_counts_per_batch():
    with pytest.raises(ValueError, match="min_pages"):
        ingest.ingest_clean(None, None, None, "out", "checkpoint", min_pages=2)
