"""WARC files as DataFrames: record split, headers, HTTP body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import computed

# A record ends with a blank line; the next one opens with the version line,
# of which any minor version is read.
RECORD_SEPARATOR = "\r\n\r\nWARC/1."
BLANK_LINE = "\r\n\r\n"


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One ``value`` row per record plus the ``warc_file`` it came from.

    Gzip cannot be split, so one task reads one file; the parallelism is the
    number of files, and no shuffle follows the scan.
    """
    return spark.read.text(paths, lineSep=RECORD_SEPARATOR).select(
        "value", F.col("_metadata.file_path").alias("warc_file")
    )


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.nullif(F.btrim(found), F.lit(""))


def _before_blank_line(value: Column) -> Column:
    return F.substring_index(value, BLANK_LINE, 1)


def _after_blank_line(value: Column) -> Column:
    """Bytes after the first blank line; cut by bytes, as a regex would decode
    the text and lose track of malformed sequences."""
    start = F.octet_length(_before_blank_line(value)) + len(BLANK_LINE) + 1
    return F.substring(value.cast("binary"), start, F.octet_length(value))


def parse_records(records: DataFrame) -> DataFrame:
    """record_id, rec_type, url, payload and the reason to reject the record, if any.

    The payload is cut to ``Content-Length`` bytes, which also drops the blank
    line that closes a file. Rejected: no type, no target on a response, fewer
    bytes than announced, more than announced besides line ends (a record that
    opens otherwise, say), a body in a transfer or content encoding.
    """
    value = F.col("value")
    head = F.regexp_replace(_before_blank_line(value), r"^(?:WARC/1\.)?[0-9]+\r\n", "")
    others = [c for c in records.columns if c != "value"]
    fields = F.struct(
        _header(head, "WARC-Record-ID").alias("record_id"),
        _header(head, "WARC-Type").alias("rec_type"),
        _header(head, "WARC-Target-URI").alias("url"),
        _header(head, "Content-Length").try_cast("bigint").alias("content_length"),
        _after_blank_line(value).alias("_raw"),
    )
    parsed = computed(records, "_fields", fields).select(*others, "_fields.*")
    size = F.octet_length("_raw")
    is_response = F.col("rec_type") == "response"
    http_head = _before_blank_line(F.col("_raw").cast("string"))
    encoded = F.startswith(http_head, F.lit("HTTP/")) & http_head.rlike(
        r"(?i)\n(?:Transfer-Encoding:[^\r\n]*chunked|Content-Encoding:[ \t]*(?:gzip|br|deflate|zstd))"
    )
    beyond = F.substring("_raw", F.least(F.col("content_length"), size).cast("int") + 1, size)
    reason = (
        F.when(F.col("rec_type").isNull(), "no record type")
        .when(is_response & F.col("url").isNull(), "no target")
        .when(F.col("content_length") > size, "truncated")
        .when(beyond.cast("string").rlike(r"[^\r\n]"), "leftover bytes")
        .when(is_response & encoded, "encoded body")
    )
    payload = F.when(
        F.col("content_length") < size, F.substring("_raw", F.lit(1), F.col("content_length").cast("int"))
    ).otherwise(F.col("_raw"))
    return parsed.select(
        *[c for c in parsed.columns if c != "_raw"],
        payload.cast("string").alias("payload"),
        reason.alias("reject"),
    )


def http_body(payload: Column) -> Column:
    """Payload without its HTTP head, malformed bytes dropped.

    Only a payload that opens with a status line has a head; anything else is
    kept whole, so a page is never cut at its first blank line.
    """
    has_head = F.startswith(payload, F.lit("HTTP/")) & F.contains(payload, F.lit(BLANK_LINE))
    body = F.when(has_head, _after_blank_line(payload).cast("string")).otherwise(payload)
    return text.drop_invalid_utf8(body)


def responses(parsed: DataFrame) -> DataFrame:
    """Sound ``response`` records with their HTML body."""
    kept = parsed.where((F.col("rec_type") == "response") & F.col("reject").isNull())
    return kept.withColumn("html", http_body(F.col("payload"))).drop("payload", "reject", "rec_type", "content_length")
