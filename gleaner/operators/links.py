"""Link sets and their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def distinct_links(lines: DataFrame) -> DataFrame:
    """Distinct stripped lines as ``url``; a blank line counts as one value."""
    return lines.select(text.strip(F.col("value")).alias("url")).distinct()


def link_stats(lines: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of lines and of distinct links, exact unless asked otherwise.

    Lines are grouped with a count first, so one hot link collapses map-side.
    """
    url = text.strip(F.col("value")).alias("url")
    if approximate:
        return lines.select(url).agg(F.count("*").alias("n_lines"), F.approx_count_distinct("url").alias("n_links"))
    return lines.groupBy(url).count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_lines"), F.count("*").alias("n_links")
    )
