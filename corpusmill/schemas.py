"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

CORPUS_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "version", "tradition", "lang", "tier", "source", "source_label")]
    + [
        T.StructField("messages", MESSAGES),
        T.StructField("confessional_refs", T.ArrayType(T.StringType())),
        T.StructField("reviewed_by", T.StringType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("sha256", T.StringType()),
    ]
)

JUDGED_RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("prompt_id", "prompt", "model", "response", "judge_model")]
    + [
        T.StructField("judge_score", T.IntegerType()),
        T.StructField("judge_rationale", T.StringType()),
        T.StructField("run_at", T.TimestampType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("enable_thinking", T.BooleanType()),
    ]
    + [T.StructField(c, T.StringType()) for c in ("pair_id", "template_id", "religion_from", "religion_to")]
    + [T.StructField("temperature", T.DoubleType()), T.StructField("seed", T.IntegerType())]
)

REVIEWED = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("reviewed_by", T.StringType()),
        T.StructField("system_prompt", T.StringType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "category", "status", "user", "assistant", "notes")]))),
    ]
)
