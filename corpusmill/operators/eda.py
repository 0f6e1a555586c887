"""Corpus profiles: counts, lengths, coverage, histograms, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(rows: DataFrame, by: Column | str, name: str = "value") -> DataFrame:
    by = F.col(by) if isinstance(by, str) else by
    return rows.groupBy(by.alias(name)).agg(F.count("*").alias("n"))


def family(source: Column | str) -> Column:
    """What is before the first underscore, or all of it."""
    return F.split_part(F.col(source) if isinstance(source, str) else source, F.lit("_"), F.lit(1))


def top(rows: DataFrame, by: Column, k: int, pos: str, name: str = "value") -> DataFrame:
    """The ``k`` most common values; of equals the one seen first."""
    return rows.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.min(pos).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def index_quantiles(rows: DataFrame, value: str, quantiles: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles by index: the item at int(n * q) of the sorted values, counted from 0.

    Equal values are counted before anything is sorted, so what is sorted is the distinct values of a group.
    """
    by = by or []
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*by)
    x = n.withColumn("_upto", F.sum("_n").over(every.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(every))
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_all") * F.lit(q)), F.col("_all") - 1), F.col(value)))
    return x.groupBy(*by).agg(*[at(q).alias(f"p{q * 100:g}".replace(".", "_")) for q in quantiles])


def length_stats(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, min, max, mean, median, and p90, p99 by index; one row, or one for each group."""
    by = by or []
    basic = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    q = index_quantiles(rows, value, (0.9, 0.99), by)
    if by:
        return basic.join(q, by)
    one = q.select(F.struct("p90", "p99").alias("q"))
    return basic.withColumn("_q", one.scalar()).select("*", "_q.p90", "_q.p99").drop("_q")


def reference_coverage(rows: DataFrame, refs: str) -> DataFrame:
    has = F.count_if(F.size(F.coalesce(refs, F.array().cast("array<string>"))) > 0)
    return rows.agg(F.count("*").alias("n"), has.alias("with_refs"), (has / F.nullif(F.count("*"), F.lit(0)) * 100).alias("pct"))


def reference_prefixes(rows: DataFrame, refs: str, k: int = 10) -> DataFrame:
    x = rows.select(F.explode(refs).alias("r")).select(F.split_part("r", F.lit(" "), F.lit(1)).alias("prefix"))
    return x.groupBy("prefix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(k)


def quality_profile(rows: DataFrame, score: str) -> DataFrame:
    x = rows.where(F.col(score).isNotNull())
    q = index_quantiles(x, score, (0.1,)).select("p10")
    return x.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min")).withColumn("p10", q.scalar())


def histogram(rows: DataFrame, value: str, width: int = 50) -> DataFrame:
    """(bucket, n) from 0 to the bucket past the largest value, empty ones included."""
    n = rows.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    span = n.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("bucket"), F.lit(width).cast("long"))).alias("bucket"))
    return span.join(n, "bucket", "left").na.fill(0, ["n"])


def against_targets(actual: DataFrame, targets: DataFrame, key: str, value: str) -> DataFrame:
    """``status`` of each target range (low, high): below, on or above; a missing value is 0."""
    x = targets.join(actual.select(key, F.col(value).alias("actual")), key, "left").na.fill(0, ["actual"])
    return x.withColumn("status", F.when(F.col("actual") < F.col("low"), "below").when(F.col("actual") > F.col("high"), "above").otherwise("on"))


def dominance(rows: DataFrame, by: str, most: float = 0.7) -> DataFrame:
    """Share of each value, and whether it is over ``most``."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("dominant", F.col("share") > most)


def tier_views(rows: DataFrame, tier: str, value: Column, name: str) -> DataFrame:
    """An aggregate by tier and over all, in one pass."""
    g = rows.groupingSets([[F.col(tier)], []], F.col(tier)).agg(value.alias(name), F.grouping(tier).alias("_all"))
    return g.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(tier)).alias("view"), name)


def prefix_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(F.left(key, F.lit(n)).alias("prefix")).agg(F.count("*").alias("n"))
