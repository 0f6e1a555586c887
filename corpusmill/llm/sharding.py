"""Sharding by jump consistent hashing (operator 5; Lamping and Veach, 2014).

A row's shard is a function of its key and the number of shards; there is no ring table. With one
more shard, a row stays where it is or goes to the new one, and 1/(n+1) of the rows go. Slots number
the rows of a shard from 0 without gaps; they come from counts of hash buckets and a running count
within each bucket, so that a shard of any size is numbered by many tasks.

Cases: a null key is hashed like any other value (all such rows share a shard); a null text has no bytes; repeated rows get
slots of their own; an empty table gives an empty result; other columns pass through, except that
``shard``, ``grown_shard`` and ``slot`` are replaced where they exist.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm._spark import pieces, running_offset


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    b = np.zeros(len(key), np.int64)
    while len(going):
        at[going] = b
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((b + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = ahead < shards
        going, key, b = going[on], key[on], ahead[on]
    return at


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return place(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, order: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` with shard, grown_shard (of one more shard) and slot."""
    x = df.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1)})
    return running_offset(x, ["shard"], order or [key], F.lit(1), "slot", buckets or pieces(df, 4, 256))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    x = assign_shards(narrow, "doc_id", 16, ["doc_id", "text_crc32", "size"], pieces(docs, 4, 256))
    return x.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
