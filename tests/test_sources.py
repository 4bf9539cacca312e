import gzip

import pytest
from pyspark.sql import functions as F

from gleaner.sources import blocklist, crawl_index, lines, responses, tables, warc


def record(kind, url, payload, length=None, rid=None):
    head = b"WARC/1.0\r\n"
    if kind:
        head += b"WARC-Type: " + kind + b"\r\n"
    if rid:
        head += b"WARC-Record-ID: " + rid + b"\r\n"
    if url:
        head += b"warc-target-uri: " + url + b"\r\n"
    length = len(payload) if length is None else length
    return head + b"Content-Length: %d\r\n\r\n" % length + payload + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


@pytest.fixture
def warc_file(tmp_path):
    bodies = [
        record(b"warcinfo", None, b"software: x"),
        record(b"request", b"http://a/", b"GET / HTTP/1.1\r\n\r\n"),
        record(b"response", b"http://a/", HTTP + b"<p>one</p>\r\n\r\n<p>two \xff</p>", rid=b"<urn:1>"),
        record(b"response", b"http://b/", b"<p>no head\r\n\r\nkept</p>"),
        record(b"response", b"http://c/", HTTP + b"cut", length=10_000),
        record(b"response", b"http://d/", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc"),
        record(b"response", None, HTTP + b"no target"),
        record(None, b"http://e/", b"no type"),
        record(b"response", b"http://f/", HTTP + b"says WARC/1.0\r\n in the body"),
        record(b"response", b"http://g/", HTTP + "Zoë �".encode()),
    ]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(gzip.compress(b) for b in bodies))
    return str(path)


def test_warc_file(spark, warc_file):
    parsed = warc.parse_records(warc.read_warc(spark, warc_file))
    rows = {(r["rec_type"], r["url"]): r for r in parsed.collect()}
    assert len(rows) == 10
    assert rows["request", "http://a/"]["payload"] == "GET / HTTP/1.1\r\n\r\n"
    reject = {k: r["reject"] for k, r in rows.items() if r["reject"]}
    assert reject == {
        ("response", "http://c/"): "truncated",
        ("response", "http://d/"): "encoded body",
        ("response", None): "no target",
        (None, "http://e/"): "no record type",
    }
    found = {r["url"]: r["html"] for r in warc.responses(parsed).collect()}
    assert found == {
        "http://a/": "<p>one</p>\r\n\r\n<p>two </p>",
        "http://b/": "<p>no head\r\n\r\nkept</p>",
        "http://f/": "says WARC/1.0\r\n in the body",
        "http://g/": "Zoë �",
    }
    assert {r["record_id"] for r in warc.responses(parsed).collect()} == {"<urn:1>", None}


def test_warc_of_another_version(spark, tmp_path):
    bodies = [record(b"response", b"http://%d/" % i, HTTP + b"<p>%d</p>" % i) for i in range(5)]
    (tmp_path / "y.warc").write_bytes(b"".join(bodies).replace(b"WARC/1.0", b"WARC/1.1"))
    parsed = warc.parse_records(warc.read_warc(spark, str(tmp_path / "y.warc")))
    assert {r["url"]: r["html"] for r in warc.responses(parsed).collect()} == {f"http://{i}/": f"<p>{i}</p>" for i in range(5)}
    # what is not split off is counted, not cut off unseen
    (tmp_path / "z.warc").write_bytes(bodies[0] + bodies[1].replace(b"WARC/1.0", b"WARC/0.18"))
    odd = warc.parse_records(warc.read_warc(spark, str(tmp_path / "z.warc"))).collect()
    assert [r["reject"] for r in odd] == ["leftover bytes"]


def values(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value STRING")


def test_path_list(spark, tmp_path):
    rows = ["\ta.warc.gz ", "b.txt", "c.gz.tmp", "", "d.gz"]
    suffix = [r["path"] for r in lines.path_list(values(spark, rows)).collect()]
    loose = [r["path"] for r in lines.path_list(values(spark, rows), "contains").collect()]
    assert sorted(suffix) == ["a.warc.gz", "d.gz"] and sorted(loose) == ["a.warc.gz", "c.gz.tmp", "d.gz"]
    with pytest.raises(ValueError):
        lines.path_list(values(spark, rows), "regex")
    with gzip.open(tmp_path / "paths.gz", "wt") as f:
        f.write("".join(f"crawl/x/{i}.warc.gz\n" for i in range(8)))
    for i in range(7):
        (tmp_path / f"{i}.warc.gz").write_text("")
    folder = str(tmp_path)
    here, missing = lines.listed_files(spark, str(tmp_path / "paths.gz"), folder + "/")
    assert here == [f"{folder}/{i}.warc.gz" for i in range(7)] and missing == [f"{folder}/7.warc.gz"]
    assert lines.listed_files(spark, str(tmp_path / "paths.gz"), folder, first=1, last=5) == ([f"{folder}/{i}.warc.gz" for i in range(1, 6)], [])


def test_article_list(spark):
    rows = ["/wiki/A_b%21 - A b!", "https://en.wikipedia.org/wiki/C - C", ""]
    got = [tuple(r) for r in lines.article_list(values(spark, rows)).collect()]
    assert got == [
        ("/wiki/A_b%21", "https://en.wikipedia.org/wiki/A_b%21", "A b!"),
        ("https://en.wikipedia.org/wiki/C", "https://en.wikipedia.org/wiki/C", "C"),
        ("", "https://en.wikipedia.org", ""),
    ]


def test_crawl_index(spark):
    rows = [
        'k 1 {"url":"http://a/,x","filename":"f","languages":"eng,fra"}',
        'k 2 {"url":"http://b/","filename":"f","languages":"zeng"}',
        'k 3 {"url":"http://c/","filename":"f"}',
        "k", "", 'k 4 {"url":"http://d/', 'k 5 {"filename":"f"}', "k 6 ",
    ]
    parsed = crawl_index.parse_index(values(spark, rows))
    assert [r["reject"] for r in parsed.collect()] == [
        None, None, None, "short line", "short line", "bad json", "missing field", "bad json",
    ]
    assert [tuple(r) for r in crawl_index.english_entries(parsed).collect()] == [("http://a/,x", "f")]


def test_blocklist_folder(spark, tmp_path):
    for name, content in {
        "adult/domains": "x.example\n\n y.example \nx.example\n", "adult/URLs": "http://u/\n",
        "ads/urls": "http://v/\n", "ads/README": "not a list\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    got = {tuple(r) for r in blocklist.read_blocklist(spark, str(tmp_path)).collect()}
    assert got == {
        ("adult", "domains", "x.example"), ("adult", "domains", "y.example"),
        ("adult", "urls", "http://u/"), ("ads", "urls", "http://v/"),
    }


def test_labelled_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    per_line = lines.read_labelled_folder(spark, str(tmp_path), 1)
    assert sorted(tuple(r) for r in per_line.collect()) == [("one", 1), ("three", 1), ("two", 1)]
    per_file = lines.read_labelled_folder(spark, str(tmp_path), 0, per_file=True)
    assert sorted(tuple(r) for r in per_file.collect()) == [("one\ntwo", 0), ("three", 0)]


def test_responses(spark, tmp_path):
    good = (
        '{"query":{"pages":{"1":{"title":"A","links":[{"title":"x"},{"title":"x"}],"extlinks":[{"*":"http://e"}]},'
        '"2":{"title":"B"}}}}'
    )
    (tmp_path / "a.json").write_text(good)
    for i, bad in enumerate(["{", '{"error":{}}', '{"query":{}}']):
        (tmp_path / f"bad{i}.json").write_text(bad)
    saved = responses.read_responses(spark, str(tmp_path))
    assert [tuple(r) for r in responses.internal_links(saved).collect()] == [("A", "x"), ("A", "x")]
    assert [tuple(r) for r in responses.external_links(saved).collect()] == [("A", "http://e")]


def test_page_csv_round_trip(spark, tmp_path):
    rows = [("http://a/?x=1,2", 'line one\nline "two", \\ end'), ("http://b/", "\r\nx\n"), ("http://c/", '"'), ("http://d/", ""), ("http://e/", None)]
    pages = spark.createDataFrame(rows, "url STRING, text STRING")
    tables.write_pages_csv(pages, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in tables.read_pages_csv(spark, str(tmp_path / "csv")).collect()) == rows
    tables.write_pages_csv(pages.limit(0), str(tmp_path / "none"))
    assert tables.read_pages_csv(spark, str(tmp_path / "none")).count() == 0


def test_picks_keep_commas_and_append(spark, tmp_path):
    picks = spark.createDataFrame([("http://a/x,y", "f,1")], "url STRING, filename STRING")
    for _ in range(2):
        tables.write_picks(picks, str(tmp_path / "picks"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "picks")).collect()] == [("http://a/x,y", "f,1")] * 2


def test_labelled_sink_drops_empty_text(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x", 1), ("b", "", 0), ("c", None, 0), ("d", "y", 0)], "title STRING, text STRING, label INT")
    tables.write_labelled(texts, str(tmp_path / "l"))
    assert sorted(tuple(r) for r in tables.read_labelled(spark, str(tmp_path / "l")).collect()) == [("a", "x", 1), ("d", "y", 0)]


def test_pages_by_file_and_merge(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "t", "w1"), ("u2", "t", "w2"), ("u1", "t", "w1")], "url STRING, text STRING, warc STRING")
    tables.write_pages(pages, str(tmp_path / "p"), by="warc")
    assert (tmp_path / "p" / "warc=w1").is_dir()
    merged = tables.merge_pages([spark.read.parquet(str(tmp_path / "p" / f"warc=w{i}")) for i in (1, 2)])
    assert merged.count() == 3


def test_predictions_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q", "d", 1, "m", 0.96, "t")], "query_id STRING, doc_id STRING, rank INT, model STRING, quality_p DOUBLE, task STRING")
    tables.write_predictions(run, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r")).select("query_id", "doc_id", "rank", "model", F.col("quality_p").cast("double"), "task")
    assert [tuple(r) for r in back.collect()] == [("q", "d", 1, "m", 0.96, "t")]


def test_pages_by_folder_come_together_before_the_write(spark, tmp_path):
    rows = spark.range(2000).select(
        F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("x"), 50).alias("text"),
        F.concat(F.lit("w"), F.col("id") % 20).alias("warc_file"),
    )
    tables.write_pages(rows.repartition(8), str(tmp_path / "out"), by="warc_file")
    assert len(list((tmp_path / "out").glob("warc_file=*/*.parquet"))) == 20
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000


def test_scratch_of_a_scope_is_deleted(spark):
    from pathlib import Path

    from gleaner import runtime

    with runtime.scratch_scope(spark):
        inside = runtime.materialise(spark.range(3), "scoped")
        assert inside.count() == 3
        path = inside.inputFiles()[0].removeprefix("file:")
        assert Path(path).exists()
    assert not Path(path).exists()
