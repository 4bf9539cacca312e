"""Blocklist folders: ``<category>/domains`` and ``<category>/URLs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls


def read_blocklist(spark: SparkSession, root: str) -> DataFrame:
    """category, kind (``domains`` or ``urls``) and value of every entry."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{domains,URLs,urls}")
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return blocklist_entries(files)


def blocklist_entries(lines: DataFrame) -> DataFrame:
    """Distinct non-blank entries of ``value`` lines with the ``path`` they lie in."""
    parts = F.split("path", "/")
    return (
        lines.select(
            urls.percent_decode(F.get(parts, F.size(parts) - 2)).alias("category"),
            F.lower(urls.last_segment(F.col("path"))).alias("kind"),
            text.strip(F.col("value")).alias("value"),
        )
        .where(text.has_text(F.col("value")))
        .distinct()
    )


def domains(blocklist: DataFrame) -> DataFrame:
    return blocklist.where(F.col("kind") == "domains").select(F.col("value").alias("domain"))


def blocked_urls(blocklist: DataFrame) -> DataFrame:
    return blocklist.where(F.col("kind") == "urls").select(F.col("value").alias("url"))
