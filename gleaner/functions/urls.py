"""URL and file-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def authority(url: Column) -> Column:
    """Host with user-info and port, letter case kept; '' if there is none.

    ``parse_url`` loses the port and fails on malformed URLs under ANSI mode.
    """
    return F.regexp_extract(url, _AUTHORITY, 1)


def parent_domains(host: Column) -> Column:
    """The host and each of its parent domains: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(F.lower(F.regexp_replace(host, r"^[^@]*@|:\d*$", "")), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def safe_file_name(url: Column, width: int = 150) -> Column:
    """Replace all but letters, digits, ``_``, ``.`` and ``-``; cut; add ``.txt``."""
    return F.concat(F.left(F.regexp_replace(url, r"[^\p{L}\p{N}_.-]", "_"), F.lit(width)), F.lit(".txt"))


def percent_decode(text: Column) -> Column:
    """Decode ``%XX`` escapes as UTF-8, malformed sequences to U+FFFD; stray
    ``%`` and ``+`` stay as they are."""
    guarded = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(guarded), text)


def title_from_url(url: Column) -> Column:
    """Last path segment, percent-decoded, underscores as spaces."""
    return F.replace(percent_decode(F.element_at(F.split(url, "/"), -1)), F.lit("_"), F.lit(" "))


def url_from_title(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """Last path segment up to its first dot."""
    return F.substring_index(last_segment(path), ".", 1)


def tail(path: Column, width: int = 12) -> Column:
    """Last ``width`` characters."""
    return F.right(path, F.lit(width))
