"""Drop rows whose key occurs in another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..runtime import BROADCAST_BYTES, broadcast_if_small, fits_broadcast, materialise


def anti_join(left: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``left`` whose ``on`` is not in ``keys``; NULL keys are kept.

    Keys measured to be small are broadcast, so wide rows never move. Larger
    key sets are first reduced to the keys that occur on the left, which
    shuffles key columns only; what remains is again broadcast if it is small.
    Otherwise it is a shuffle join, where AQE splits hot keys of the left side.
    """
    distinct = keys.select(on).where(F.col(on).isNotNull()).distinct()
    if not fits_broadcast(distinct, limit):
        if left.isStreaming:
            return left.join(distinct, on, "left_anti")
        present = left.select(on).distinct()
        distinct = materialise(present.join(keys.select(on), on, "left_semi"), "present-keys")
        if not fits_broadcast(distinct, limit):
            return left.join(distinct, on, "left_anti")
    return left.join(F.broadcast(distinct), on, "left_anti")


def novel_urls(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Crawl entries whose URL is not a known link; duplicates survive."""
    return anti_join(entries, known, "url")


def drop_blocked(
    pages: DataFrame, domains: DataFrame, blocked: DataFrame, match_parents: bool = False
) -> DataFrame:
    """Pages whose authority and URL are both off the lists.

    Two equality joins, as one ``OR`` condition would be a nested loop. Call it
    before text extraction, which is far more costly per row. With
    ``match_parents`` a listed domain also blocks its sub-domains, port and
    letter case aside; by default the authority must match as it stands.
    """
    if match_parents:
        return drop_blocked_with_parents(pages, domains, blocked)
    keyed = pages.withColumn("domain", urls.authority(F.col("url")))
    return anti_join(anti_join(keyed, domains, "domain").drop("domain"), blocked, "url")


def drop_blocked_with_parents(pages: DataFrame, domains: DataFrame, blocked: DataFrame) -> DataFrame:
    """As above for sub-domains: hosts are few against pages, so the listed
    hosts are found first and the pages meet only those."""
    if pages.isStreaming:
        raise ValueError("match_parents needs the hosts of all pages, so it does not run on a stream")
    lowered = domains.select(F.lower("domain").alias("domain")).distinct()
    hosts = pages.select(urls.authority(F.col("url")).alias("host")).distinct()
    listed = (
        hosts.select("host", F.explode(urls.parent_domains(F.col("host"))).alias("domain"))
        .join(broadcast_if_small(lowered), "domain", "left_semi")
        .select("host")
    )
    keyed = pages.withColumn("host", urls.authority(F.col("url")))
    return anti_join(anti_join(keyed, listed, "host").drop("host"), blocked, "url")


def mark_member(left: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """Add boolean ``name``: whether ``on`` occurs in ``keys``."""
    flags = keys.select(on).where(F.col(on).isNotNull()).distinct().withColumn(name, F.lit(True))
    joined = left.join(broadcast_if_small(flags), on, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def stage_counts(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each stage, where a row must pass all earlier stages.

    One pass and one aggregation; ``stages`` maps a name to its condition.
    """
    passed, counts = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    names = list(stages)
    totals = rows.agg(*counts)
    entries = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, n in enumerate(names)]
    return totals.select(F.inline(F.array(*entries)))


def reject_counts(parsed: DataFrame) -> DataFrame:
    """Records per reject reason; sound records count as ``ok``."""
    return parsed.groupBy(F.coalesce("reject", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
