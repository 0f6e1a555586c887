"""Incremental runs with Structured Streaming: results arrive as files, are scored and kept once per prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.replies import cb_score


def results_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def scored(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("judge_score", cb_score(reply))


def append_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; the checkpoint makes a restart go on where this left off."""
    return stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_scored(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each key's first scored row within the watermark ``late``."""
    return stream.where(F.col("judge_score").isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_scores(stream: DataFrame, at: str, late: str, width: str) -> DataFrame:
    """Scored rows and their mean by time window, for watching a run."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("judge_score").alias("n_scored"), F.avg("judge_score").alias("mean_score"))
