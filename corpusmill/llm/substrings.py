"""Exact substring dedup with suffix arrays (operator 1).

Every byte string of ``window`` bytes that starts at two places of the corpus, in one text or two, is
removed wherever it occurs. Equal windows share an anchor (see ``_repeats``), so texts are cut into segments by
anchor, and anchors into shards: the suffixes that could match are in one shard's array. Each shard
sorts its suffixes by induced sorting (``suffixarray``) and reads the repeats off the permuted common prefixes. Equal
segments are collapsed before, however many there are. An anchor with segments of more than ``hot`` bytes
in all (a passage that very many texts quote, each with other surroundings) would be one shard's whole load: its windows
are dealt by hashes of all their bytes instead, and equal hashes (128 bits) count as equal.

Cases: a null text is an empty one; shorter texts than ``window`` have no windows and stay; repeated rows
are copies of each other; very long texts are cut like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _repeats as R
from corpusmill.llm._spark import materialize
from corpusmill.llm.suffixarray import repeated_starts

GRAM, HOT, SHARD = 32, 1 << 18, 1 << 20


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    parts, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(b"".join(parts)).hexdigest()


def _fetch(kind: R.Kind, shards: int, hot: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, offs, place = R.texts_of(left)
        wide = right.column("weight").to_numpy() > hot
        cold = R.rows_where(right, ~wide)
        key = cold.column("key").to_numpy()
        text = [R.binary_at(data, offs, place[r], s, s + w + kind.window - 1) for r, s, w in zip(cold.column("row").to_pylist(), cold.column("start").to_pylist(), cold.column("windows").to_pylist(), strict=True)]
        n = len(text)
        arrays = pa.table(
            {
                "shard": pa.array((key.view(np.uint64) % np.uint64(shards)).astype(np.int32)),
                "key": key,
                "content": cold.column("content").to_numpy(),
                "lo": pa.array(np.zeros(n, np.int32)),
                "hi": pa.array(np.zeros(n, np.int32)),
                "a": pa.array(np.zeros(n, np.int64)),
                "b": pa.array(np.zeros(n, np.int64)),
                "many": pa.array(np.zeros(n, bool)),
                "member": cold.column("single").combine_chunks() if n else pa.array([], pa.bool_()),
                "text": pa.array(text, pa.binary()),
            }
        )
        return pa.concat_tables([arrays, R.compare_rows(R.window_rows(kind, R.rows_where(right, wide), data, offs, place), shards).cast(arrays.schema)])

    return run


def _sort(window: int):
    def run(t: pa.Table) -> pa.Table:
        hashed = R.is_null(t, "text")
        by_hash = R.decided_windows(R.rows_where(t, hashed))
        own = R.rows_where(t, ~hashed)
        member = own.column("member").to_numpy(zero_copy_only=False)
        found = repeated_starts([np.frombuffer(x.as_py(), np.uint8) for x in own.column("text")], window)
        found = [f if m else f[:0] for f, m in zip(found, member, strict=True)]
        n = np.array([len(f) for f in found], np.int64)
        spread = lambda c: np.repeat(own.column(c).to_numpy(), n)
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        return R.verdict_table(*(np.concatenate(x) for x in zip((spread("key"), spread("content"), at, at + 1), by_hash, strict=True)))

    return run


def repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200, gram: int = GRAM, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kind = R.Kind(False, window, min(gram, window))
    docs = R.numbered(df, key, text)
    segments = materialize(R.segments_of(docs, kind), "suffix-segments")
    keys = materialize(segments.groupBy("key").agg(F.sum(F.when(F.col("inner"), 2).otherwise(1)).alias("n")).where("n > 1").select("key"), "suffix-anchors")
    cand = R.candidates(segments, keys)
    verdicts, open_ = R.groups(cand)
    open_ = materialize(open_.withColumn("weight", F.col("weight") + F.lit(window)), "suffix-open")
    size = open_.agg(F.sum(F.col("windows") + F.lit(window))).first()[0] or 0
    shards = max(8, -(-size // shard))
    chunks = R.number_of_chunks(df)
    fetched = R.fetch(docs, open_, chunks, _fetch(kind, shards, hot))
    sorted_ = materialize(fetched.groupBy("shard").applyInArrow(_sort(window), R.VERDICT), "suffix-verdicts")
    kind_of_key = df.schema[key].dataType.simpleString()
    return R.finish(docs, cand, verdicts.unionByName(sorted_), kind, chunks, f"{key} {kind_of_key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _kept)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
