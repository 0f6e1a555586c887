"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns the columns of
``docs``; the last one adds where each row goes. ``run`` applies them to the table documents, each stage's
rows written as Parquet in the shared folder and read again; what a stage wrote besides is deleted then.

Cases: rows with a null or empty text have no words and end at the quality rules; null ids, languages and sources are
values like others; of repeated rows one stays; very long texts are worked on whole; columns beyond those of the table
documents go along, but for those named as the last stage's; an empty table gives no rows at any stage.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm._spark import apart, discard, evaluated, numbered_rows
from corpusmill.llm.decontamination import remove_contaminated
from corpusmill.llm.mixing import mixed_texts
from corpusmill.llm.quality import judge_quality
from corpusmill.llm.sharding import assign_shards
from corpusmill.llm.simhash import near_documents

SHARDS = 16
CORE = ("doc_id", "text", "lang", "source", "n_chars")
PLACED = ("shard", "slot", "grown_shard")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their group's limits accept."""
    return apart(docs, CORE, lambda x: judge_quality(x).where("q_kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, of equal ids the text with the least hash.

    Groups are found by SimHash and verified; an exact join finds what fingerprints miss.
    """
    return apart(docs, CORE, _first_of_each_group)


def _first_of_each_group(docs: DataFrame) -> DataFrame:
    rows = numbered_rows(docs, "pipeline-rows")
    # the least of these stays: null ids last, of equal ids the text with the least hash
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "row")
    found = near_documents(rows.select("row", "text", order.alias("order")), "order", numbered=True)
    first = found.where("key = component").select("key.row")
    return rows.join(first.hint("merge"), "row", "left_semi").drop("row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of any benchmark n-gram; the others go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return apart(docs, CORE, lambda x: remove_contaminated(x, benchmark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document and pass; a part of a document keeps its taken words."""
    return apart(docs, CORE, lambda x: mixed_texts(x).withColumn("n_chars", F.length("text").cast("long")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, texts and other columns included, with their shard and their slot in it."""
    return apart(docs, CORE, lambda x: assign_shards(x, "doc_id", SHARDS, ["doc_id", "n_chars", "text"]), PLACED)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: near-dedup and mixing are beyond SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, evaluated(partial(stage, spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
