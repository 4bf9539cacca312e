"""Plain string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that Unicode-aware whitespace stripping removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
REPLACEMENT = "\ufffd"
_STAND_IN = "\ufdd0"  # a noncharacter, never assigned


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends (plain ``trim`` drops only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """True for non-null, non-empty text."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def drop_invalid_utf8(text: Column) -> Column:
    """Remove malformed byte sequences, keep everything else.

    Genuine U+FFFD characters are parked on a noncharacter while the malformed
    bytes pass through it.
    """
    parked = F.replace(text, F.lit(REPLACEMENT), F.lit(_STAND_IN))
    cleaned = F.replace(F.make_valid_utf8(parked), F.lit(REPLACEMENT), F.lit(""))
    restored = F.replace(cleaned, F.lit(_STAND_IN), F.lit(REPLACEMENT))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
