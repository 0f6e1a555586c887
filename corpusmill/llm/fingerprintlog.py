"""Substring dedup with a log-structured fingerprint index (operator 7).

The index keeps fingerprints of historical windows: the anchors that ``_repeats`` chooses, at least one in every
window of 35 words. A run is an immutable table sorted by fingerprint: (key, n), in a folder of its own below the log's,
named by the batches that it covers. A log that is passed in by its path also keeps texts and segments, so that later tables are held against earlier ones. A new batch is merge-joined with the runs there are, which tells what has occurred before; it then
becomes a run itself, and runs are compacted when there are ``fanout`` of them. A log is opened again by its path. Keys that are known, or
occur twice in their batch, are candidates; they are verified by the windows themselves: all 35 words of each, by a hash of 128 bits of their bytes.

Cases: a null text has no words; texts of fewer words than a window stay as they are; repeated rows are copies of each other; very
long texts are cut like others; an empty batch makes an empty run; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _repeats as R
from corpusmill.llm._spark import materialize, scratch_dir

WINDOW, GRAM, BATCHES, FANOUT = 35, 6, 2, 2


class FingerprintLog:
    """Sorted immutable runs of fingerprints with their counts, below ``path``.

    A run ``run-a-b`` holds batches a to b. It counts once it is written whole; a shorter run that it covers is left over from a
    compaction and is deleted when the log is opened. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        top = self._path(self.path)
        self.fs = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []
        spans = [tuple(map(int, n.split("-")[1:])) for n in found if n.startswith("run-") and self.fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        self.runs = sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))
        for n in found:
            if n.startswith("run-") and tuple(map(int, n.split("-")[1:])) not in self.runs:
                self.fs.delete(self._path(f"{self.path}/{n}"), True)

    def _run(self, span: tuple[int, int]) -> str:
        return f"{self.path}/run-{span[0]:08d}-{span[1]:08d}"

    def _read(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("key long, n long").parquet(self._run(span))

    def _write(self, rows: DataFrame, span: tuple[int, int]) -> None:
        rows.sortWithinPartitions("key").write.mode("overwrite").option("compression", "zstd").parquet(self._run(span))

    def append(self, keys: DataFrame) -> DataFrame:
        """Add a batch: (key, n), a key in any number of rows. Gives the batch's keys that are known from before or that it has twice."""
        at = self.runs[-1][1] + 1 if self.runs else 0
        self._write(keys.groupBy("key").agg(F.sum("n").alias("n")), (at, at))
        again = self.again(self._read((at, at)))
        self.runs.append((at, at))
        if len(self.runs) >= self.fanout:
            self.compact()
        return again

    def again(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch (key, n: one row a key) that are known from before or that it has twice."""
        return materialize(self.known(batch).select("key").unionByName(batch.where("n > 1").select("key")).distinct(), "fingerprint-known")

    def known(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is in a run: a merge join with each."""
        out = keys.limit(0)
        for span in self.runs:
            out = out.unionByName(keys.join(self._read(span).select("key").hint("merge"), "key", "left_semi"))
        return out.distinct()

    def compact(self) -> None:
        """Merge all runs into one, pair by pair, and delete them."""
        while len(self.runs) > 1:
            old = self.runs[-2:]
            a, b = self._read(old[0]).withColumnRenamed("n", "m").hint("merge"), self._read(old[1])
            both = a.join(b, "key", "full").select("key", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))
            self._write(both, (old[0][0], old[1][1]))
            self.runs[-2:] = [(old[0][0], old[1][1])]
            for span in old:
                self.fs.delete(self._path(self._run(span)), True)

    def repeated(self) -> DataFrame:
        """Keys that have occurred at least twice, over all batches."""
        self.compact()
        return self._read(self.runs[0]).where("n > 1").select("key") if self.runs else self.spark.createDataFrame([], "key long")


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    words = text.split()  # bytes: exactly the six ASCII spaces
    parts, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts += words[at:a]
        at = b
    parts += words[at:]
    return len(words), int((ends - starts).sum()), hashlib.sha256(b" ".join(parts)).hexdigest()


def _windows(kind: R.Kind, shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return R.compare_rows(R.window_rows(kind, right, *R.texts_of(left)), shards)

    return run


def _verify(t: pa.Table) -> pa.Table:
    return R.verdict_table(*R.decided_windows(t))


def repeated_words(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, log: str | None = None) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row; the table goes into an index of its own in ``batches`` parts.

    With ``log``, the table is the next batch of the index at that path: its words go if they repeat in it or have occurred in any batch before.
    Earlier results stay as they are. Keys must be of one type in all batches.
    """
    kind = R.Kind(True, window, min(gram, window))
    out = f"{key} {df.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    if log is not None:
        return _next_batch(df, key, text, kind, log.rstrip("/"), out)
    docs = R.numbered(df, key, text)
    segments = materialize(R.segments_of(docs, kind), "log-segments")
    index = FingerprintLog(df.sparkSession, f"{scratch_dir(df.sparkSession)}/fingerprint-log-{uuid.uuid4().hex}")
    again = []
    for k in range(batches):
        again.append(index.append(_keys(segments.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == k))))
    cand = R.candidates(segments, reduce(DataFrame.unionByName, again).distinct())
    return R.finish(docs, cand, _verdicts(docs, cand, kind, R.number_of_chunks(df)), kind, R.number_of_chunks(df), out, _kept)


def _keys(segments: DataFrame) -> DataFrame:
    return segments.select("key", F.when(F.col("inner"), 2).otherwise(1).cast("long").alias("n"))


def _verdicts(docs: DataFrame, cand: DataFrame, kind: R.Kind, chunks: int) -> DataFrame:
    """The windows of candidate segments that repeat among them, by all their words; texts come from ``docs``."""
    verdicts, open_ = R.groups(cand)
    open_ = materialize(open_, "log-open")
    size = open_.agg(F.sum("windows")).first()[0] or 0
    shards = max(8, -(-size // (1 << 18)))
    fetched = R.fetch(docs, open_, chunks, _windows(kind, shards))
    return verdicts.unionByName(materialize(fetched.groupBy("shard").applyInArrow(_verify, R.VERDICT), "log-verdicts"))


#: bits of a row's number within its batch
PLACE = 52


def _next_batch(df: DataFrame, key: str, text: str, kind: R.Kind, log: str, out: str) -> DataFrame:
    """A batch against all before it. The log holds, besides its runs, the texts and segments of every batch, in folders of their own.

    What a call that ended has left is written again by the next one: a batch counts once its run is there, which is written last, behind the result.
    """
    spark = df.sparkSession
    index = FingerprintLog(spark, log)
    no = index.runs[-1][1] + 1 if index.runs else 0
    texts, parts = f"{log}/texts", f"{log}/segments"
    rows = df.select((F.lit(no << PLACE) + F.monotonically_increasing_id()).alias("row"), F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{texts}/batch={no}")
    new = spark.read.schema(rows.schema).parquet(f"{texts}/batch={no}")
    if (new.agg(F.max("row")).first()[0] or 0) >= no + 1 << PLACE:
        raise ValueError("a batch of too many partitions: repartition it")
    R.segments_of(new, kind).write.mode("overwrite").option("compression", "zstd").parquet(f"{parts}/batch={no}")
    segments = spark.read.schema(R.SEGMENT).parquet(*[f"{parts}/batch={k}" for k in range(no + 1)])
    docs = spark.read.schema(rows.schema).parquet(*[f"{texts}/batch={k}" for k in range(no + 1)])
    keys = materialize(_keys(spark.read.schema(R.SEGMENT).parquet(f"{parts}/batch={no}")).groupBy("key").agg(F.sum("n").alias("n")), "log-keys")
    cand = R.candidates(segments, index.again(keys))
    verdicts = _verdicts(docs, cand, kind, R.number_of_chunks(docs))
    result = materialize(R.finish(new, cand.where(F.col("row") >= no << PLACE), verdicts, kind, R.number_of_chunks(new), out, _kept), "log-result")
    index.append(keys)
    return result


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
