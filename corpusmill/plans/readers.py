"""Queries that write given tables as files and read them back by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, parsers, records
from corpusmill.plans.evaluation import rounded
from corpusmill.plans.tables import TRANSITIONS_SQL, query, table, transitions
from corpusmill.sources import files
from corpusmill.sources.scratch import scratch_path

EVENT = "event_id long, event_type string, value double"


def _lines(spark: SparkSession, d: str, bad: bool) -> str:
    """Events as JSON lines; every tenth is cut off if ``bad``."""
    path = scratch_path(spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 10 == 0, F.left(line, F.lit(9))).otherwise(line) if bad else line
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return path


def _kind(spark: SparkSession):
    return spark.createDataFrame([], EVENT).schema


@query("jsonl_scan", "SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines that cannot be read are dropped."""
    return files.jsonl(spark, _lines(spark, d, True), _kind(spark))


@query("jsonl_scan_strict", "SELECT event_id, event_type, value FROM events")
def jsonl_scan_strict(spark: SparkSession, d: str) -> DataFrame:
    return files.jsonl(spark, _lines(spark, d, False), _kind(spark), strict=True)


@query("jsonl_scan_bad", "SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS bad FROM events")
def jsonl_scan_bad(spark: SparkSession, d: str) -> DataFrame:
    x = files.jsonl_with_bad_lines(spark, _lines(spark, d, True), _kind(spark))
    return x.agg(F.count("event_id").alias("good"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"))


@query("tier_scan", "SELECT doc_id, lang, sha256(text) AS sha FROM documents WHERE lang IN ('en', 'de')")
def tier_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two tiers that are there and one that is not."""
    path = scratch_path(spark, "tiers")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    for lang in ("en", "de"):
        docs.where(F.col("lang") == lang).write.json(f"{path}/{lang}")
    x = files.tiers(spark, {lang: f"{path}/{lang}" for lang in ("en", "xx", "de")}, docs.schema)
    return x.select("doc_id", "lang", F.sha2("text", 256).alias("sha"))


@query("reviewed_scan", "SELECT item_id::VARCHAR AS id, text AS question, 'doutrina' AS source_label FROM benchmark WHERE item_id % 3 <> 0")
def reviewed_scan(spark: SparkSession, d: str) -> DataFrame:
    """A reviewed file for each ten benchmark items: those marked ok or edited are taken."""
    path = scratch_path(spark, "reviewed")
    status = F.when(F.col("item_id") % 3 == 0, "drop").when(F.col("item_id") % 3 == 1, "ok").otherwise("edit")
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("fato").alias("category"), status.alias("status"), F.col("text").alias("user"), F.lit("answer").alias("assistant"))
    x = table(spark, d, "benchmark").groupBy((F.col("item_id") % 10).alias("file")).agg(F.lit("2").alias("version"), F.collect_list(item).alias("items"))
    x.repartition("file").write.partitionBy("file").json(path)
    return records.reviewed_items(files.reviewed(spark, path)).select("id", "question", "source_label")


@query(
    "matrix_scan",
    f"SELECT religion_from AS row, religion_to AS col, round(avg(judge_score), 9) AS value FROM ({TRANSITIONS_SQL}) WHERE judge_score IS NOT NULL GROUP BY ALL",
)
def matrix_scan(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by direction, written as a line for each row of the matrix, and read as its cells."""
    path = scratch_path(spark, "matrix")
    cells = transitions(spark, d).where("judge_score IS NOT NULL").groupBy("religion_from", "religion_to").agg(F.avg("judge_score").alias("v"))
    rows = cells.groupBy(F.col("religion_from").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("religion_to", "v"))).alias("cells"))
    rows.write.json(path)
    return rounded(files.matrix(spark, path))


@query(
    "matrix_pivot",
    f"""SELECT religion_from AS row, round(avg(judge_score) FILTER (religion_to = 'FRANCE'), 9) AS "FRANCE", round(avg(judge_score) FILTER (religion_to = 'CHINA'), 9) AS "CHINA" FROM ({TRANSITIONS_SQL}) GROUP BY ALL
HAVING count(judge_score) > 0""",
)
def matrix_pivot(spark: SparkSession, d: str) -> DataFrame:
    cells = evaluation.group_means(transitions(spark, d).withColumn("both", F.concat_ws("|", "religion_from", "religion_to")), ["both"])
    at = F.split("value", r"\|")
    return rounded(files.pivoted(cells.select(at[0].alias("row"), at[1].alias("col"), F.col("mean_score").alias("value")), ["FRANCE", "CHINA"]))


@query(
    "parse_dispatch",
    """SELECT 'WLC_' || item_id AS source, 'What is ' || item_id || '?' AS question FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT 'Heidelberg_' || item_id, 'What is ' || item_id || '?' FROM benchmark WHERE item_id % 2 = 1""",
)
def parse_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two sources, each parsed by its own rule and written on its own; a third source has none."""
    n = F.col("item_id").cast("string")
    text = F.concat(n, F.lit(". What is "), n, F.lit("?\n\n"), F.when(F.col("item_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("")), F.lit("An answer that is long enough"))
    docs = table(spark, d, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "wlc").otherwise("heidelberg").alias("doc"), text.alias("text"))
    rows, _, failures = parsers.parse_apart(docs, scratch_path(spark, "parsed"), ["wlc", "heidelberg", "wsc"])
    if failures:
        raise RuntimeError(str(failures))
    return rows.select("source", "question")


@query("day_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day_stamps(spark: SparkSession, d: str) -> DataFrame:
    return records.stamped(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), F.col("ts")).select("event_id", "created_at", "day")
