"""Crawl records to clean pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import has_text
from ..operators.boilerplate import drop_boilerplate
from ..operators.language import LanguageModel, keep_language
from ..operators.membership import anti_join, drop_blocked
from ..runtime import computed, materialise
from ..sources import blocklist as bl
from ..sources import warc


EXTRACTS = {"page": html.html_to_text, "article": html.article_text, "main": html.main_block}


def page_texts(pages: DataFrame, blocklist: DataFrame, match_parents: bool = False, extract: str = "page") -> DataFrame:
    """url, html pages to url, text pages: blocklist, extraction (one of
    ``EXTRACTS``), empty filter.

    Row-local apart from the blocklist join, so it also runs on a stream. The
    blocklist comes first: extraction is the costly step.
    """
    allowed = drop_blocked(pages, bl.domains(blocklist), bl.blocked_urls(blocklist), match_parents)
    texts = computed(allowed, "text", EXTRACTS[extract](F.col("html"))).drop("html")
    return texts.where(has_text(F.col("text")))


def clean_pages(
    pages: DataFrame,
    blocklist: DataFrame,
    model: LanguageModel,
    language: str = "en",
    above: float = 0.6,
    curated_urls: DataFrame | None = None,
    min_pages: int | None = None,
    page_id: str = "page_id",
    extract: str = "page",
) -> DataFrame:
    """url, html pages to url, text pages in one language.

    Optional: leave out the URLs of a curated corpus, drop blocks that a host
    repeats on ``min_pages`` pages.
    """
    # Only the URL decides here: before extraction, the costly step.
    if curated_urls is not None:
        pages = anti_join(pages, curated_urls, "url")
    # Later steps read the texts or their URLs again; reading and extracting
    # the raw pages twice would cost far more than this table.
    texts = materialise(page_texts(pages, blocklist, extract=extract), "page-texts")
    if min_pages is not None:
        texts = drop_boilerplate(texts, min_pages, page_id)
    return keep_language(texts, model, language, above, page_id)


def with_page_id(pages: DataFrame) -> DataFrame:
    """Identify WARC pages by record id; a page without one is identified by
    its content, so that equal pages share an id."""
    content = F.sha2(F.concat_ws(" ", F.lit("content"), "url", "html"), 256)
    return pages.withColumn("page_id", F.coalesce("record_id", content)).drop("record_id")


def clean_warc(records: DataFrame, blocklist: DataFrame, model: LanguageModel, **options) -> DataFrame:
    """WARC records, parsed or as text (``value``), to clean pages."""
    parsed = warc.parse_records(records) if "value" in records.columns else records
    pages = with_page_id(warc.responses(parsed))
    return clean_pages(pages, blocklist, model, **options).drop("page_id")
