"""Resumed runs as keyed state: of each key's results the latest scored one, or else the latest, whatever order they arrive in.

The state is Spark's own for streaming aggregates: one row a key, kept in the state store, brought on by each batch of arrivals and
restored from the checkpoint after a restart. Each batch gives the keys that it changed, and goes into a log of batches exactly once;
the last row of a key in the log is its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmill.sources.versions import append_batch, batches


def latest(results: DataFrame, key: str = "prompt_id", score: str = "judge_score", seq: str = "seq") -> DataFrame:
    """The row of each key that counts, and ``pos``, its first place. Rows without a key all count, each on its own. For tables and streams."""
    names = [c for c in results.columns if c != key]
    alone = F.when(F.col(key).isNull(), F.col(seq)).alias("_alone")
    best = results.groupBy(key, alone).agg(F.max_by(F.struct(*names), F.struct(F.col(score).isNotNull(), F.col(seq))).alias("_r"), F.min(seq).alias("pos"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in names], "pos")


def keep_latest(stream: DataFrame, log: str, checkpoint: str, key: str = "prompt_id", score: str = "judge_score", seq: str = "seq") -> StreamingQuery:
    """Work on what has arrived since the checkpoint, add the changed keys to ``log``, and stop."""
    changed = latest(stream, key, score, seq)

    def add(rows: DataFrame, batch: int) -> None:
        append_batch(rows, log, batch)

    return changed.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, log: str, schema: T.StructType, key: str = "prompt_id", seq: str = "seq") -> DataFrame:
    """What the log says of each key now: the row of its last batch. ``schema``: the columns of :func:`latest`."""
    x = batches(spark, log, schema)
    alone = F.when(F.col(key).isNull(), F.col(seq)).alias("_alone")
    last = x.groupBy(key, alone).agg(F.max_by(F.struct(*[f.name for f in schema.fields]), "batch").alias("_r"))
    return last.select("_r.*")


def resume_from(prompts: DataFrame, log: str, schema: T.StructType, key: str = "prompt_id", score: str = "judge_score") -> DataFrame:
    """Prompts whose result in the log is missing or has no score: they are judged again."""
    done = kept(prompts.sparkSession, log, schema, key).where(F.col(score).isNotNull()).select(key)
    return prompts.join(done, key, "left_anti")
