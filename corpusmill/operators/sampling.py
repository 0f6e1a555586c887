"""Stratified splits and samples. Order is by hash of seed and key: reruns agree, at any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import half_even


def shuffled(key: Column | str, seed: int) -> Column:
    """A key's place in the shuffle; a null key goes as an empty one."""
    key = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def hash_ranked(rows: DataFrame, group: list[str], key: str, seed: int, out: str = "rank", cells: int = 256) -> DataFrame:
    """``rows`` with their rank, from 1, in the shuffled order of their group, and ``group_rows``.

    The first two hex digits of the hash cut a group into ``cells`` ranges: counts by cell give each cell's first
    rank, and rows are ranked within cells, so a group of any size is many tasks' work.
    """
    x = rows.withColumn("_h", shuffled(key, seed)).withColumn("_c", F.left("_h", F.lit(2)))
    n = x.groupBy(*group, "_c").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*group)
    base = n.withColumn("_base", F.coalesce(F.sum("_n").over(every.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = base.withColumn("group_rows", F.sum("_n").over(every)).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_c").alias("_gc"), "_base", "group_rows")
    on = F.col("_c") == F.col("_gc")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_c").orderBy("_h", key)))
    return x.join(base, on).withColumn(out, F.col("_base") + F.col("_r")).drop("_h", "_c", "_gc", "_base", "_r", *[f"_g{i}" for i in range(len(group))])


def stratified_split(rows: DataFrame, tier: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``split``: eval for max(1, round(n * fraction)) rows of each tier, train for the rest. Null tiers are ``?``."""
    if not 0.01 <= fraction <= 0.30:
        raise ValueError("the eval fraction must be from 0.01 to 0.30")
    x = hash_ranked(rows.withColumn("_tier", F.coalesce(tier, F.lit("?"))), ["_tier"], key, seed)
    n_eval = F.greatest(F.lit(1), half_even(F.col("group_rows") * F.lit(fraction)).cast("long"))
    return x.withColumn("split", F.when(F.col("rank") <= n_eval, "eval").otherwise("train")).drop("_tier", "rank", "group_rows")


def three_way_split(rows: DataFrame, strata: list[str], key: str, fractions: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """train, eval and test by cumulative fractions within each stratum."""
    x = hash_ranked(rows, strata, key, seed)
    upto = lambda f: half_even(F.col("group_rows") * F.lit(f)).cast("long")
    split = F.when(F.col("rank") <= upto(fractions[0]), "train").when(F.col("rank") <= upto(sum(fractions)), "eval").otherwise("test")
    return x.withColumn("split", split).drop("rank", "group_rows")


def split_manifest(rows: DataFrame, tier: str) -> DataFrame:
    return rows.groupBy("split", F.coalesce(tier, F.lit("?")).alias("tier")).agg(F.count("*").alias("n_records"))


def fraction_sample(rows: DataFrame, groups: list[str], key: str, fraction: float, seed: int = 42) -> DataFrame:
    """max(1, round(n * fraction)) rows of each group."""
    x = hash_ranked(rows, groups, key, seed)
    return x.where(F.col("rank") <= F.greatest(F.lit(1), half_even(F.col("group_rows") * F.lit(fraction)).cast("long"))).drop("rank", "group_rows")


def uniform_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(shuffled(key, seed), key).limit(n)


def modal_sample(rows: DataFrame, score: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About half from the most common score, half from the others; where either is scarce, the other fills up.

    Of equally common scores, the one that the smallest key has counts as most common.
    """
    scored = rows.where(F.col(score).isNotNull())
    modal = scored.groupBy(score).agg(F.count("*").alias("n"), F.min(key).alias("first")).agg(F.max_by(score, F.struct("n", -F.col("first"))).alias("modal"))
    x = hash_ranked(scored.withColumn("is_modal", F.col(score) == modal.scalar()), ["is_modal"], key, seed)
    x = x.withColumn("all_rows", scored.agg(F.count("*")).scalar())
    n_modal_rows = F.when(F.col("is_modal"), F.col("group_rows")).otherwise(F.col("all_rows") - F.col("group_rows"))
    n_other = F.least(F.col("all_rows") - n_modal_rows, F.greatest(F.lit(n // 2), F.lit(n) - n_modal_rows))
    n_modal = F.least(n_modal_rows, F.lit(n) - n_other)
    return x.where(F.col("rank") <= F.when(F.col("is_modal"), n_modal).otherwise(n_other)).drop("rank", "group_rows", "all_rows")


def blind_template(sample: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """(template, key): what a labeller sees, without the judge's score, and the scores apart."""
    shown = [c for c in ("prompt_id", "prompt", "response") if c in sample.columns]
    template = sample.select(*shown, *([F.concat_ws(" -> ", "religion_from", "religion_to").alias("transition")] if "religion_from" in sample.columns else []))
    template = template.withColumn("human_score", F.lit(None).cast("int")).withColumn("_scale", F.lit(f"{low}-{high}"))
    return template, sample.select("prompt_id", "judge_score")
