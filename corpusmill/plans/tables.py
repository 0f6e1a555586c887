"""Registration of queries, and the tables of judged results that they derive from the event log.

The test tables hold no judged results. These are computed from ``events`` with integer arithmetic
that Spark and DuckDB share: a prompt for each user, a judgement for each event, none where the event is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str, scale: str = "cb", side: int = 0) -> DataFrame:
    """Judged results; ``side`` 1 is a second run over the same prompts."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") * (3 + 2 * side) + F.col("user_id")
    score = k % 7 + 1 if scale == "cb" else k % 5
    return e.select(
        F.col("user_id").alias("prompt_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", score.cast("int")).alias("judge_score"),
        F.col("value").alias("cost"),
        F.col("event_type").alias("template_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("p"), (F.col("event_id") % 6).cast("string"))).alias("pair_id"),
    )


def results_sql(scale: str = "cb", side: int = 0) -> str:
    score = f"(event_id * {3 + 2 * side} + user_id) % " + ("7 + 1" if scale == "cb" else "5")
    return f"""SELECT user_id AS prompt_id, event_id AS seq, CASE WHEN event_type <> 'error' THEN ({score})::INT END AS judge_score,
  value AS cost, event_type AS template_id, CASE WHEN event_id % 11 <> 0 THEN 'p' || (event_id % 6) END AS pair_id FROM events"""


LATEST_SQL = """SELECT prompt_id, arg_max(judge_score, seq) AS s FROM ({0}) WHERE judge_score IS NOT NULL GROUP BY prompt_id"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged transitions between nations: from a customer's to a supplier's, for each line of an order."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("religion_from")), "c_nationkey")
    x = x.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("religion_to")), "s_nationkey")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return x.select(k.alias("prompt_id"), F.when(k % 13 != 0, (k * k % 7 + 1).cast("int")).alias("judge_score"), "religion_from", "religion_to")


TRANSITIONS_SQL = """SELECT l_orderkey * 7 + l_linenumber AS prompt_id,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0 THEN ((l_orderkey * 7 + l_linenumber) * (l_orderkey * 7 + l_linenumber) % 7 + 1)::INT END AS judge_score,
  f.n_name AS religion_from, t.n_name AS religion_to
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation f ON c_nationkey = f.n_nationkey JOIN nation t ON s_nationkey = t.n_nationkey"""
