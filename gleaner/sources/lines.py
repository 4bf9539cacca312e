"""Line-oriented inputs: path lists, article lists, link lists, labelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..runtime import file_exists


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One ``value`` row per line; compressed files are decoded by the scan."""
    return spark.read.text(paths)


def path_list(lines: DataFrame, match: str = "suffix") -> DataFrame:
    """Stripped paths that end in (``suffix``) or hold (``contains``) ``.gz``."""
    path = text.strip(F.col("value")).alias("path")
    stripped = lines.select(path)
    if match == "suffix":
        return stripped.where(F.col("path").endswith(".gz"))
    if match == "contains":
        return stripped.where(F.col("path").contains(".gz"))
    raise ValueError(f"match must be 'suffix' or 'contains', not {match!r}")


def path_slice(paths: list[str], first: int = 0, last: int | None = None) -> list[str]:
    """Entries ``first`` to ``last`` (from 0, inclusive) of a list of file names;
    without bounds the whole list."""
    return paths[first:] if last is None else paths[first : last + 1]


def listed_files(
    spark: SparkSession, list_file: str, folder: str, first: int = 0, last: int | None = None
) -> tuple[list[str], list[str]]:
    """Local names in ``folder`` of a path-list file, or of a slice of it: those
    that are there, and those that are not. A listed file that was not fetched is
    no reason to stop; the caller reports it.

    File names are metadata the scan needs before it starts; the list has one
    line per crawl file and is read in file order.
    """
    listed = [row["path"] for row in path_list(read_lines(spark, list_file).coalesce(1)).collect()]
    names = [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[-1]}" for path in path_slice(listed, first, last)]
    here = {name for name in names if file_exists(spark, name)}
    return [n for n in names if n in here], [n for n in names if n not in here]


def article_list(lines: DataFrame, base: str = "https://en.wikipedia.org") -> DataFrame:
    """``href - title`` lines: href, full URL and the title the href spells."""
    href = F.get(F.split("value", " ", 2), F.lit(0))
    absolute = href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    return lines.select(
        href.alias("href"),
        F.when(absolute, href).otherwise(F.concat(F.lit(base), href)).alias("url"),
        urls.title_from_url(href).alias("title"),
    )


def labelled_lines(lines: DataFrame, label: int) -> DataFrame:
    return lines.select(F.col("value").alias("text"), F.lit(label).alias("label"))


def read_labelled_folder(spark: SparkSession, path: str, label: int, per_file: bool = False) -> DataFrame:
    """Every line (or, with ``per_file``, every file) of a folder with one label."""
    return labelled_lines(spark.read.text(path, wholetext=per_file), label)
