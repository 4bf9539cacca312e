"""Saved link lists to crawl picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import distinct_links, link_stats
from ..operators.membership import novel_urls
from ..operators.sampling import crawl_pick
from ..sources.crawl_index import english_entries, parse_index
from ..sources.responses import external_links


def links_from_responses(responses: DataFrame) -> DataFrame:
    """External links of all responses as link-list lines."""
    return external_links(responses).select(F.col("link").alias("value"))


def pick_crawl_urls(index_lines: DataFrame, link_lines: DataFrame, seed: int = 42) -> DataFrame:
    """As many English crawl entries off the link list as it has distinct links."""
    quota = link_stats(link_lines).first()["n_links"]
    novel = novel_urls(english_entries(parse_index(index_lines)), distinct_links(link_lines))
    return crawl_pick(novel, quota, seed)
