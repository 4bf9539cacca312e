"""Incremental page cleaning: each input file is taken exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.language import LanguageModel
from ..plans.clean_pages import clean_pages, page_texts, with_page_id
from ..runtime import scratch_scope
from ..sources import warc

PAGES = "page_id BIGINT, url STRING, html STRING"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Pages from Parquet files as they appear under ``path`` (folder or glob)."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def warc_stream(spark: SparkSession, folder: str, glob: str = "*.warc.gz", files_per_batch: int = 1000) -> DataFrame:
    """Pages of sound responses from WARC files as they appear in ``folder``."""
    records = (
        spark.readStream.option("pathGlobFilter", glob)
        .option("lineSep", warc.RECORD_SEPARATOR)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("warc_file"))
    )
    return with_page_id(warc.responses(warc.parse_records(records)))


def ingest(pages: DataFrame, blocklist: DataFrame, out: str, checkpoint: str) -> None:
    """Clean all files not yet seen, append them to ``out`` and stop.

    The checkpoint remembers the files, so a second run adds nothing; the file
    sink commits each batch once, also after a failure.
    """
    texts = page_texts(pages, blocklist)
    query = (
        texts.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()


def ingest_clean(
    pages: DataFrame, blocklist: DataFrame, model: LanguageModel, out: str, checkpoint: str, **options
) -> None:
    """The whole cleaning job, language filter included, for files not yet seen.

    The language score aggregates over a page, so each micro-batch is cleaned
    as a batch. Its folder carries the batch number and is overwritten when the
    batch is retried, so no page is written twice. ``min_pages`` is refused: what
    a host repeats would depend on which files share a batch.
    """
    if options.get("min_pages") is not None:
        raise ValueError("min_pages counts over a whole corpus; drop boilerplate from the ingested pages instead")

    def clean(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            cleaned = clean_pages(batch, blocklist, model, **options)
            cleaned.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        pages.writeStream.foreachBatch(clean)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
