"""Saved API responses that list the links of encyclopedia pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE = (
    "query STRUCT<pages: MAP<STRING, STRUCT<title: STRING, "
    "links: ARRAY<STRUCT<title: STRING>>, extlinks: ARRAY<STRUCT<`*`: STRING>>>>>"
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One ``value`` row per response file."""
    return spark.read.text(path, wholetext=True)


def _pages(responses: DataFrame) -> DataFrame:
    parsed = responses.select(F.from_json("value", RESPONSE).alias("r"))
    return parsed.select(F.explode("r.query.pages").alias("page_key", "page"))


def internal_links(responses: DataFrame) -> DataFrame:
    """title, link for every internal link; a broken response gives no row."""
    return _pages(responses).select(
        F.col("page.title").alias("title"), F.explode("page.links.title").alias("link")
    )


def external_links(responses: DataFrame) -> DataFrame:
    """title, link for every external link; a broken response gives no row."""
    return _pages(responses).select(
        F.col("page.title").alias("title"),
        F.explode(F.transform("page.extlinks", lambda x: x["*"])).alias("link"),
    )
