"""Crawl index lines: ``<key> <timestamp> <json>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import computed

ENTRY = "url STRING, filename STRING, languages STRING, _broken STRING"


def parse_index(lines: DataFrame) -> DataFrame:
    """url, filename, languages and the reason to reject the line, if any.

    A rejected line has no fields, whatever could be read of it.
    """
    body = F.get(F.split("value", " ", 3), F.lit(2))
    entry = F.from_json(body, ENTRY, {"columnNameOfCorruptRecord": "_broken"})
    parsed = computed(lines.select("value"), "p", F.struct(body.isNull().alias("_short"), entry.alias("e"))).select("p.*")
    reason = (
        F.when(F.col("_short"), "short line")
        .when(F.col("e._broken").isNotNull() | F.col("e").isNull(), "bad json")
        .when(F.col("e.url").isNull() | F.col("e.filename").isNull(), "missing field")
    )
    judged = parsed.select("e.*", reason.alias("reject"))
    sound = F.col("reject").isNull()
    return judged.select(*[F.when(sound, F.col(c)).alias(c) for c in ("url", "filename", "languages")], "reject")


def declares(languages: Column, code: str = "eng") -> Column:
    """True if the comma list names exactly ``code``; NULL lists do not."""
    return F.coalesce(F.array_contains(F.split(languages, ","), code), F.lit(False))


def english_entries(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject").isNull() & declares(F.col("languages"))).select("url", "filename")
