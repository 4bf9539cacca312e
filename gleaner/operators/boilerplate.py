"""Text blocks that a host repeats over its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..runtime import broadcast_if_small, computed, materialise


def _digest(block: Column) -> Column:
    return F.unhex(F.md5(block.cast("binary")))


def _page_blocks(pages: DataFrame, *keep: str) -> DataFrame:
    """host and block: the distinct non-empty blocks of each page."""
    distinct = F.filter(F.array_distinct(html.blocks(F.col("text"))), lambda b: b != "")
    return pages.select(*keep, urls.authority(F.col("url")).alias("host"), F.explode(distinct).alias("block"))


def _repeated(seen: DataFrame, min_pages: int) -> DataFrame:
    """host, digest of the blocks on at least ``min_pages`` pages of a host.

    Blocks are distinct inside a page, so a plain count is the number of pages
    and repeated blocks collapse map-side. Only 16-byte digests are shuffled:
    most blocks occur once, and their text need not travel.
    """
    counts = seen.groupBy("host", _digest(F.col("block")).alias("digest")).count()
    return materialise(counts.where(F.col("count") >= min_pages).select("host", "digest"), "repeated-blocks")


def _hits(seen: DataFrame, min_pages: int) -> DataFrame:
    repeated = broadcast_if_small(_repeated(seen, min_pages))
    return seen.withColumn("digest", _digest(F.col("block"))).join(repeated, ["host", "digest"], "left_semi")


def host_boilerplate(pages: DataFrame, min_pages: int = 2) -> DataFrame:
    """host, block and the number of the host's pages that hold the block."""
    found = _hits(_page_blocks(pages), min_pages)
    return found.groupBy("host", "block").agg(F.count("*").alias("n_pages"))


def drop_boilerplate(pages: DataFrame, min_pages: int = 2, page_id: str = "page_id") -> DataFrame:
    """Pages without the blocks their host repeats; a page left empty is dropped.

    The pages themselves are joined once, by their id, to the set of their own
    repeated blocks. Pages with one id must be copies of each other. ``pages``
    is read three times and should be a stored table.
    """
    hits = (
        _hits(_page_blocks(pages, page_id), min_pages)
        .groupBy(page_id)
        .agg(F.collect_set("digest").alias("_repeated"))
    )
    kept = F.filter(html.blocks(F.col("text")), lambda b: ~F.array_contains("_repeated", _digest(b)))
    cleaned = F.when(F.col("_repeated").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = computed(pages.join(hits, page_id, "left"), "text", cleaned)
    return joined.drop("_repeated").where(F.length("text") > 0).select(*pages.columns)
