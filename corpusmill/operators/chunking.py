"""Overlapping windows of characters, and evenly spaced samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.hashing import chunk_hash
from corpusmill.functions.text import half_even, let, strip


def windows(text: Column, size: int = 4000, overlap: int = 500, least: int = 200) -> Column:
    """Array of stripped windows of more than ``least`` characters; the last window reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    step = size - overlap
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + overlap < n))
    cut = F.transform(starts, lambda s: strip(F.substring(text, s + 1, F.lit(size))))
    return F.filter(cut, lambda c: F.length(c) > least)


def evenly(items: Column, most: int) -> Column:
    """At most ``most`` items, evenly spaced from the first to the last; the first alone if ``most`` is 1."""
    return let(items, lambda x: _evenly(x, most))


def _evenly(items: Column, most: int) -> Column:
    n = F.size(items)
    if most == 1:
        some = F.slice(items, 1, 1)
    else:
        at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: half_even(i * (n - 1) / F.lit(float(most - 1))).cast("int"))
        some = F.transform(F.array_sort(F.array_distinct(at)), lambda i: F.get(items, i))
    return F.when(n > most, some).otherwise(items)


def chunks(docs: DataFrame, key: str, text: str, size: int = 4000, overlap: int = 500, least: int = 200, most: int | None = None) -> DataFrame:
    """(key, chunk_idx, chunk, chunk_hash) of every document, sampled evenly where it has more than ``most``."""
    w = windows(F.col(text), size, overlap, least)
    w = evenly(w, most) if most else w
    x = docs.select(key, F.posexplode(w).alias("chunk_idx", "chunk"))
    return x.withColumn("chunk_hash", chunk_hash(F.col(key).cast("string"), "chunk_idx", "chunk"))
