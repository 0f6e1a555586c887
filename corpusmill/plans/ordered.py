"""Queries that need one order over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import ordered
from corpusmill.plans.evaluation import rounded
from corpusmill.plans.tables import query, table


@query(
    "running_spend",
    "SELECT event_id, sum(value::DECIMAL(18,2)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent FROM events",
)
def running_spend(spark: SparkSession, d: str) -> DataFrame:
    """What a run over all events has spent after each of them."""
    x = table(spark, d, "events").select("event_id", "ts", F.col("value").cast("decimal(18,2)").alias("cost"))
    return ordered.running_total(x, "cost", ["ts", "event_id"], "spent").select("event_id", F.col("spent").cast("double").alias("spent"))


@query(
    "budget_of_all",
    """SELECT l_orderkey, l_linenumber, spent::DOUBLE AS spent FROM (
SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS spent FROM lineitem) WHERE spent <= 100000""",
)
def budget_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Lines in the order of their shipping, up to the one that goes over a budget of 100,000 pieces."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").cast("long").alias("cost"))
    x = ordered.within_budget(x, "cost", ["l_shipdate", "l_orderkey", "l_linenumber"], 100_000)
    return x.select("l_orderkey", "l_linenumber", F.col("spent").cast("double").alias("spent"))


@query(
    "early_stop_of_all",
    """WITH e AS (SELECT event_id, value, min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
i AS (SELECT *, best IS NULL OR coalesce(value < best - 0.001, false) AS improved FROM e), g AS (SELECT *, sum(improved::INT) OVER (ORDER BY event_id) AS g FROM i),
w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) - 1 AS waited FROM g), s AS (SELECT min(event_id) FILTER (waited >= 400) AS stop FROM w)
SELECT event_id, waited, improved FROM w, s WHERE stop IS NULL OR event_id <= stop""",
)
def early_stop_of_all(spark: SparkSession, d: str) -> DataFrame:
    """All events as one history of evaluations, with a patience of 400."""
    x = table(spark, d, "events").select("event_id", "value")
    return ordered.early_stop(x, 400, 0.001, "value", "event_id").select("event_id", "waited", "improved")


@query(
    "line_numbers",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate NULLS FIRST, l_extendedprice, l_orderkey, l_linenumber) AS rank FROM lineitem",
)
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every line's place in the order of shipping and price."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return ordered.with_ranks(x, ["l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber"], "rank").select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query(
    "line_fdr",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, ((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % 9973 + 1) / 10000.0::DOUBLE AS p FROM lineitem),
s AS (SELECT *, CASE WHEN l_linenumber = 3 THEN p / 1000 ELSE p END AS q0 FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY q0, l_orderkey, l_linenumber) AS rk, count(*) OVER (PARTITION BY l_returnflag) AS m FROM s)
SELECT l_orderkey, l_linenumber, round(min(least(1.0, q0 * m / rk)) OVER (PARTITION BY l_returnflag ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 9) AS q FROM r""",
)
def line_fdr(spark: SparkSession, d: str) -> DataFrame:
    """A test for each line, those of third lines with small p: adjusted within each flag, of which one holds half of all lines."""
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey")) % 9973 + 1) / 10000.0
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") == 3, p / 1000).otherwise(p).alias("p"))
    return rounded(ordered.false_discovery(x, "p", run=["l_returnflag"]).select("l_orderkey", "l_linenumber", "q"))


@query(
    "price_quantiles",
    """WITH r AS (SELECT l_returnflag, l_extendedprice AS p, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(p) FILTER (k = floor(n * 0.1)) AS p10, max(p) FILTER (k = floor(n * 0.9)) AS p90, max(p) FILTER (k = floor(n * 0.99)) AS p99 FROM r GROUP BY l_returnflag""",
)
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return ordered.range_quantiles(table(spark, d, "lineitem"), "l_extendedprice", (0.1, 0.9, 0.99), ["l_returnflag"])
