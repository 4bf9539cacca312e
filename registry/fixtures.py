"""Inputs the test tables lack, derived from them row by row."""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.runtime import computed
from gleaner.sources.blocklist import blocklist_entries
from gleaner.sources.tables import read_table

BAD_HOSTS = "(adult-x|ads-track|free-bets|spam-farm|casino-win|cheap-pills)"
NAV = html.container_pattern("nav")
CRLF = "\r\n"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", *columns)


def pages(spark, folder, *columns):
    return table(spark, folder, "pages", *columns)


def documents(spark, folder, *columns):
    return table(spark, folder, "documents", *columns)


def page_texts(spark, folder) -> DataFrame:
    """page_id, url and extracted text of every page."""
    scan = pages(spark, folder, "page_id", "url", "html")
    return computed(scan, "text", html.html_to_text(F.col("html"))).drop("html")


def path_lines(spark, folder) -> DataFrame:
    url = F.col("url")
    suffix = F.when(url.endswith(".html"), ".txt").when(url.endswith("#top"), ".gz.tmp").otherwise(".gz")
    lead = F.when(url.startswith("https"), "\t").otherwise("")
    return pages(spark, folder, "page_id", "url").select(
        F.concat(lead, F.lit("crawl/CC-"), F.col("page_id").cast("string"), F.lit(".warc"), suffix, F.lit(" ")).alias("value")
    )


def index_lines(spark, folder) -> DataFrame:
    """Short for URLs that end in '/', broken JSON for German .html pages, no
    languages for French pages with a feed tag, a look-alike code for Spanish."""
    url, lang = F.col("url"), F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1)
    languages = (
        F.when((lang == "fr") & url.contains("utm_source"), "")
        .when(lang == "en", ',"languages":"eng,fra"')
        .when(lang == "fr", ',"languages":"fra"')
        .when(lang == "de", ',"languages":"deu"')
        .otherwise(',"languages":"zeng,spa"')
    )
    head = F.concat(F.lit("k "), F.col("page_id").cast("string"))
    name = F.concat(F.lit('","filename":"crawl/'), F.col("page_id").cast("string"), F.lit('.warc.gz"'))
    body = F.concat(F.lit('{"url":"'), url, name, languages)
    line = (
        F.when(url.endswith("/"), head)
        .when((lang == "de") & url.endswith(".html"), F.concat(head, F.lit(" "), body))
        .otherwise(F.concat(head, F.lit(" "), body, F.lit("}")))
    )
    return pages(spark, folder, "page_id", "url").select(line.alias("value"))


def link_lines(spark, folder) -> DataFrame:
    """Pages with a page number are the known links, each listed twice."""
    known = pages(spark, folder, "url").where(F.col("url").contains("?page="))
    return known.select(F.explode(F.array("url", F.concat(F.lit(" "), "url", F.lit("\t")))).alias("value"))


def curated_urls(spark, folder) -> DataFrame:
    return pages(spark, folder, "url").where(F.col("url").endswith(".html"))


def warc_records(spark, folder) -> DataFrame:
    """A request and a response per page. Announced too long for .html pages, a
    chunked body for numbered pages, no target for pages that end in '/'."""
    url = F.col("url")
    encoding = F.when(url.contains("?page="), f"Transfer-Encoding: chunked{CRLF}").otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), encoding, F.lit(f"Content-Type: text/html{CRLF}{CRLF}"), "html")
    spare = F.when(url.endswith(".html"), 9).otherwise(0)
    target = F.when(url.endswith("/"), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)))
    identity = F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(f">{CRLF}"))
    response = F.concat(
        F.lit(f"WARC-Type: response{CRLF}"), identity, target,
        F.lit("Content-Length: "), (F.octet_length(http) + spare).cast("string"), F.lit(f"{CRLF}{CRLF}"), http,
    )
    get = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = F.concat(
        F.lit(f"WARC-Type: request{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(get).cast("string"), F.lit(f"{CRLF}{CRLF}"), get,
    )
    scan = pages(spark, folder, "page_id", "url", "html")
    return scan.select(F.explode(F.array(request, response)).alias("value"), F.lit("crawl.warc.gz").alias("warc_file"))


def warc_files(spark, folder, out: str) -> DataFrame:
    """The records above as gzipped WARC files of several members, in turn of
    version 1.0 and 1.1, and their index: url, filename, offset, length."""

    def run(batches):
        number = TaskContext.get().partitionId()
        name = f"part-{number:05d}.warc.gz"
        system, root = pa.fs.FileSystem.from_uri(out)
        system.create_dir(root)
        rows, at = [], 0
        with system.open_output_stream(f"{root}/{name}.{uuid.uuid4().hex}") as stream:
            made = stream
            for batch in batches:
                for url, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = gzip.compress(f"WARC/1.{number % 2}{CRLF}{value}{CRLF}{CRLF}".encode(), 1, mtime=0)
                    made.write(data)
                    rows.append((url, name, at, len(data)))
                    at += len(data)
        for info in system.get_file_info(pa.fs.FileSelector(root)):  # a retry leaves one file as well
            if info.base_name.startswith(f"{name}."):
                system.move(info.path, f"{root}/{name}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["url", "filename", "offset", "length"])

    records = warc_records(spark, folder).select(F.regexp_extract("value", r"WARC-Target-URI: ([^\r\n]*)", 1).alias("url"), "value")
    return records.repartition(4, "value").mapInArrow(run, "url string, filename string, offset long, length long")


def blocklist_lines(spark, folder) -> DataFrame:
    """Domains of the bad hosts by kind of host, and the '#top' URLs."""
    bad = F.regexp_extract("url", BAD_HOSTS, 1)
    host = urls.authority(F.col("url"))
    entries = F.array(
        F.struct(F.concat(host, F.lit(" ")).alias("value"), F.concat(F.lit("/lists/"), bad, F.lit("/domains")).alias("path")),
        F.struct(F.col("url").alias("value"), F.lit("/lists/fragment/URLs").alias("path")),
        F.struct(F.lit("").alias("value"), F.lit("/lists/fragment/URLs").alias("path")),
    )
    rows = pages(spark, folder, "url").select("url", bad.alias("bad"), F.inline(entries))
    listed = (F.col("path").endswith("domains") & (F.col("bad") != "")) | (
        F.col("path").endswith("URLs") & (F.col("url").endswith("#top") | (F.col("value") == ""))
    )
    return rows.where(listed).select("value", "path")


def blocklist(spark, folder) -> DataFrame:
    return blocklist_entries(blocklist_lines(spark, folder))


def responses(spark, folder, listed=None) -> DataFrame:
    """One API response per page: its nav links and its own URL (with ``listed``
    only where this condition holds). Cut short for URLs that end in '/'."""
    links = F.transform(
        html.anchors(F.col("html"), NAV), lambda a: F.struct(a["anchor"].alias("title"))
    )
    page = F.struct(
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        links.alias("links"),
        F.filter(F.array(F.struct(F.col("url").alias("*"))), lambda _: F.lit(True) if listed is None else listed).alias("extlinks"),
    )
    doc = F.to_json(F.struct(F.struct(F.create_map(F.col("page_id").cast("string"), page).alias("pages")).alias("query")))
    return pages(spark, folder, "page_id", "url", "html").select(
        F.when(F.col("url").endswith("/"), F.substring(doc, 1, 20)).otherwise(doc).alias("value")
    )


def article_lines(spark, folder) -> DataFrame:
    """``href - title`` of every nav link; the href is percent-encoded unless
    the link ends in a comma, and always ends in a stray percent and a plus."""
    links = pages(spark, folder, "html").select(F.inline(html.anchors(F.col("html"), NAV)))
    encoded = F.replace(F.replace(F.url_encode("anchor"), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    plain = F.replace("anchor", F.lit(" "), F.lit("_"))
    href = F.concat(F.lit("/wiki/"), F.when(F.col("anchor").endswith(","), plain).otherwise(encoded))
    return links.select(F.concat(href, F.lit("_100%_a+b - "), "anchor").alias("value"))


def labelled_documents(spark, folder) -> DataFrame:
    labels = table(spark, folder, "labels", "doc_id", "quality")
    return documents(spark, folder, "doc_id", "text").join(labels, "doc_id")


def embeddings(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label")


def class_logits(spark, folder) -> DataFrame:
    """All entries of a vector as the logits of as many classes."""
    return embeddings(spark, folder).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def fixed_logit(model: int):
    """The whole vector weighted by small whole numbers, one pattern per model."""
    weighted = F.transform(
        "embedding", lambda x, i: x.cast("double") * (((i + 1) * (model + 2)) % 5 - 2).cast("double")
    )
    return F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)


def classifier_output(spark, folder) -> DataFrame:
    raw = fixed_logit(1) + 0.5
    return embeddings(spark, folder).select("vec_id", raw.alias("logit"), (F.col("label") < 5).cast("int").alias("label"))
