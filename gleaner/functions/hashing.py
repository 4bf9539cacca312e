"""Words counted by hash buckets that any engine can reproduce."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = "struct<at: array<int>, x: array<double>>"


def bucket(word: str, size: int) -> int:
    """The first 32 bits of the word's MD5 digest, modulo ``size``."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % size


def bucket_counts(words: Column, size: int) -> Column:
    """How often the buckets of an array of words occur: places in ascending order
    and counts. A word is hashed once for each batch; a null array has none."""

    @F.arrow_udf(COUNTS)
    def counted(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        places = np.array([bucket(w, size) for w in flat.dictionary.to_pylist()], np.int64)
        filled = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(lists)), np.where(np.asarray(lists.is_valid()), filled, 0))
        codes = row * size + places[np.asarray(flat.indices)] if len(row) else np.zeros(0, np.int64)
        found, number = np.unique(codes, return_counts=True)
        offsets = pa.array(np.searchsorted(found, np.arange(len(lists) + 1) * size).astype(np.int32))
        at = pa.ListArray.from_arrays(offsets, pa.array((found % size).astype(np.int32)))
        return pa.StructArray.from_arrays([at, pa.ListArray.from_arrays(offsets, pa.array(number.astype(float)))], ["at", "x"])

    return counted(words)
