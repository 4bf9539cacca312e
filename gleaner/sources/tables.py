"""Columnar inputs, cleaned-page files and result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread

PAGE_SCHEMA = "url STRING, text STRING"
_CSV = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"',
    # An empty field is NULL, a quoted empty one is empty text.
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# Rows per output file, so that one hot partition value becomes many files.
FILE_ROWS = 1_000_000


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Chosen columns of a Parquet table, spread over the cores if it is small."""
    scan = spark.read.parquet(path)
    return spread(scan.select(*columns) if columns else scan)


def read_curated(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A local export of a curated corpus; only the asked columns are read."""
    return spark.read.parquet(path).select(*(columns or ("url", "text")))


def read_pages_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cleaned pages from CSV. Text holds newlines, so files cannot be split:
    prefer Parquet for anything large."""
    return spark.read.csv(paths, schema=PAGE_SCHEMA, **_CSV)


def write_pages_csv(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    options = {k: v for k, v in _CSV.items() if k != "multiLine"}
    pages.select("url", "text").write.mode(mode).csv(path, **options)


def write_pages(pages: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Cleaned pages as Parquet, optionally one folder per ``by`` value.

    With ``by`` the rows are first brought together by it: after a shuffle every
    task holds rows of every folder, and would write a file into each. Spark
    splits a large value over several tasks and merges small ones.
    """
    if by:
        pages = pages.sparkSession.sql(f"SELECT /*+ REBALANCE(`{by}`) */ * FROM {{pages}}", pages=pages)
    writer = pages.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS)
    (writer.partitionBy(by) if by else writer).parquet(path)


def merge_pages(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, duplicates kept."""
    return reduce(DataFrame.unionByName, parts)


def write_labelled(texts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """title, text rows in one folder per label; empty texts are left out."""
    kept = texts.where(F.length("text") > 0)
    kept.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("label").parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("title STRING, text STRING, label INT").parquet(path)


def write_picks(picks: DataFrame, path: str, mode: str = "append") -> None:
    """url, filename pairs as columns: a comma in a URL does no harm."""
    picks.select("url", "filename").write.mode(mode).parquet(path)


def write_predictions(runs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ranked documents of each evaluation run, one folder per run setting."""
    writer = runs.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy("model", "quality_p", "task").parquet(path)
