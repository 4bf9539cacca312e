"""Records framed by their lengths, and single records by offset."""

import gzip
import io

import pytest

from gleaner.sources import warc, warc_files


def record(payload, url="http://a/", kind="response", version="1.0", length=None, extra=""):
    body = payload if isinstance(payload, bytes) else payload.encode()
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:1>\r\n"
    head += f"WARC-Target-URI: {url}\r\n" if url else ""
    size = len(body) if length is None else length
    head += f"Content-Length: {size}\r\n" if size != "none" else ""
    return (head + extra + "\r\n").encode() + body + b"\r\n\r\n"


HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
SEPARATOR = "text\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nmore"


def summary(rows):
    return [(r[1], r[2], len(r[4]), r[5]) for r in rows]


@pytest.mark.parametrize("chunk", [1 << 20, 7, 64])
@pytest.mark.parametrize("packed", ["plain", "members", "one member"])
def test_frames(monkeypatch, chunk, packed):
    monkeypatch.setattr(warc_files, "CHUNK", chunk)
    rows = [
        record("software: x\r\n", None, "warcinfo"), record(HTTP + SEPARATOR, "http://a/1"), record("GET /", "http://a/1", "request", "1.1"),
        record(HTTP + "é日本" * 50, "http://a/2", version="1.1"), record(b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe", "http://a/3"), record("", "http://a/4"),
        record(HTTP.replace("Content-Type: text/html", "Transfer-Encoding: chunked") + "x", "http://a/5"), record(HTTP, None),
    ]
    data = {"plain": b"".join(rows), "members": b"".join(map(gzip.compress, rows)), "one member": gzip.compress(b"".join(rows))}[packed]
    got = list(warc_files.file_records(io.BytesIO(data)))
    size = [len(r.split(b"\r\n\r\n", 1)[1]) - 4 for r in rows]
    reasons = [None] * 6 + ["encoded body", "no target"]
    kinds = ["warcinfo", "response", "request"] + ["response"] * 5
    urls = [None, "http://a/1", "http://a/1", "http://a/2", "http://a/3", "http://a/4", "http://a/5", None]
    assert summary(got) == list(zip(kinds, urls, size, reasons))
    assert got[1][4].decode() == HTTP + SEPARATOR and got[4][4].endswith(b"\xff\xfe")


def test_damaged_files():
    good = record("ok", "http://a/")
    long = record("short", "http://b/", length=500)
    members = gzip.compress(long) + gzip.compress(good)
    assert summary(warc_files.file_records(io.BytesIO(members))) == [("response", "http://b/", 5, "truncated"), ("response", "http://a/", 2, None)]
    junk = b"not a record at all\r\n" + good + b"WARC/0.9\r\nx\r\n\r\n" + good
    got = summary(warc_files.file_records(io.BytesIO(junk)))
    assert [g[3] for g in got] == ["no record type", None, "no record type", None]
    assert summary(warc_files.file_records(io.BytesIO(good[:-30] + b"")))[-1][3] in ("truncated", None)
    assert list(warc_files.file_records(io.BytesIO(b""))) == []
    cut = gzip.compress(good) + gzip.compress(good)[:-20]
    assert summary(warc_files.file_records(io.BytesIO(cut)))[0] == ("response", "http://a/", 2, None)
    assert warc_files.frames(record("x", length="none"))[0][0][4] == b""


def test_files_and_picks(spark, tmp_path):
    rows = {f"http://a/{i}": record(HTTP + f"page {i} " + SEPARATOR * (i % 3), f"http://a/{i}", version=f"1.{i % 2}") for i in range(40)}
    index, at = [], 0
    with open(tmp_path / "a.warc.gz", "wb") as file:
        for url, data in rows.items():
            packed = gzip.compress(data)
            index.append((url, "a.warc.gz", at, len(packed)))
            at += file.write(packed)
    (tmp_path / "b.warc").write_bytes(b"".join(rows.values()))
    plain = rows["http://a/7"]
    index.append(("http://a/7", "b.warc", b"".join(rows.values()).index(plain), len(plain)))
    whole = warc_files.read_files(spark, str(tmp_path))
    assert whole.columns == ["warc_file", "record_id", "rec_type", "url", "content_length", "payload", "reject"]
    pages = {(r["url"], r["warc_file"][-8:]): r["html"] for r in warc.responses(whole).collect()}
    assert len(pages) == 80 and pages["http://a/4", ".warc.gz"] == "page 4 " + SEPARATOR
    picks = spark.createDataFrame([*index[::3], index[-1], ("u", "none.warc", 0, 10), ("u", "a.warc.gz", 3, 5), ("u", None, 1, 1)], "url STRING, filename STRING, offset LONG, length LONG")
    got = warc_files.read_records(picks, str(tmp_path))
    assert sorted(r["url"] for r in warc.responses(got).collect()) == sorted([i[0] for i in index[::3]] + ["http://a/7"])
    assert sorted(r["reject"] for r in got.where("reject IS NOT NULL").collect()) == ["no file", "no record type"]
