"""Paired tests, agreement and multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import ordered
from corpusmill.operators.evaluation import mean_interval


def pairs(before: DataFrame, after: DataFrame, key: str = "prompt_id", score: str = "judge_score", seq: str | None = None) -> DataFrame:
    """(key, before, after, delta) of prompts scored on both sides; of several rows of a side the last by ``seq`` counts."""

    def side(d: DataFrame, name: str) -> DataFrame:
        d = d.where(F.col(score).isNotNull())
        return d.groupBy(key).agg(F.max_by(score, seq).alias(name)) if seq else d.select(key, F.col(score).alias(name))

    return side(before, "before").join(side(after, "after"), key).withColumn("delta", F.col("after") - F.col("before"))


def paired_delta(paired: DataFrame) -> DataFrame:
    """One row: means, mean delta with its interval, improved, worsened, tied, rank-biserial effect size."""
    d = F.col("delta")
    m = mean_interval(d)
    up, down = F.count_if(d > 0), F.count_if(d < 0)
    return paired.agg(
        F.count("*").alias("n_pairs"),
        F.avg("before").alias("before_mean"),
        F.avg("after").alias("after_mean"),
        *[m[f].alias(g) for f, g in (("mean", "mean_delta"), ("sd", "sd_delta"), ("low", "delta_low"), ("high", "delta_high"))],
        up.alias("n_improved"),
        down.alias("n_worsened"),
        F.count_if(d == 0).alias("n_tied"),
        ((up - down) / F.nullif(up + down, F.lit(0))).alias("rank_biserial"),
    )


def signed_ranks(paired: DataFrame) -> DataFrame:
    """One row: n, r_plus, r_minus, tie_term (sum of t^3 - t over ties), zero deltas left out.

    Ranks come from counts by size: average rank = rows below + (t + 1) / 2. Deltas on an ordinal scale have few
    sizes, whatever the number of pairs, so nothing is sorted but the sizes.
    """
    sizes = paired.where("delta <> 0").groupBy(F.abs("delta").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("delta") > 0).alias("up"))
    below = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    x = sizes.withColumn("rank", F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2.0)
    zero = F.lit(0.0)
    return x.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("up")), zero).alias("r_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("t") - F.col("up"))), zero).alias("r_minus"),
        F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("tie_term"),
    )


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def wilcoxon(n: int, r_plus: float, r_minus: float, tie_term: float) -> dict[str, float | None]:
    """Statistic and two-sided p: exact for 50 pairs or fewer without ties, else the normal approximation with ties."""
    stat = min(r_plus, r_minus)
    if n == 0:
        return {"stat": None, "p": None}
    if n <= 50 and tie_term == 0:
        ways = [1]
        for rank in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank and s - rank < len(ways) else 0) for s in range(len(ways) + rank)]
        return {"stat": stat, "p": min(1.0, 2 * sum(ways[: int(stat) + 1]) / 2**n)}
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    z = (stat - n * (n + 1) / 4) / math.sqrt(var) if var > 0 else 0.0
    return {"stat": stat, "p": normal_tail(z)}


def weighted_kappa(rated: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Quadratic-weighted kappa, in one pass: the scale's width cancels out of its weights."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count("*")
    den = F.sum(x * x) + F.sum(y * y) - 2 * F.sum(x) * F.sum(y) / n
    return rated.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or [])).agg(n.alias("n"), F.when(den == 0, 1.0).otherwise(1 - F.sum((x - y) * (x - y)) / F.nullif(den, F.lit(0.0))).alias("kappa"))


def agreement(rated: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """One row: exact and near agreement, kappa, a verdict; degenerate if a rater used one level. Off-scale ratings fail."""
    ok = F.col(a).between(low, high) & F.col(b).between(low, high)
    checked = rated.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where(F.when(~ok, F.raise_error(F.lit("rating off the scale")).cast("boolean")).otherwise(F.lit(True)))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count("*")
    den = F.sum(x * x) + F.sum(y * y) - 2 * F.sum(x) * F.sum(y) / n
    kappa = F.when(den == 0, 1.0).otherwise(1 - F.sum((x - y) * (x - y)) / F.nullif(den, F.lit(0.0)))
    out = checked.agg(n.alias("n"), F.avg((x == y).cast("double")).alias("exact"), F.avg((F.abs(x - y) <= 1).cast("double")).alias("within_one"), F.avg(x - y).alias("mean_difference"), kappa.alias("kappa"), ((F.count_distinct(a) < 2) | (F.count_distinct(b) < 2)).alias("degenerate"))
    k = F.col("kappa")
    verdict = F.when(F.col("degenerate"), "degenerate").when(k >= 0.8, "near-perfect").when(k >= 0.6, "substantial").when(k >= 0.4, "moderate").otherwise("weak")
    return out.withColumn("verdict", verdict)


def confusion(rated: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """Counts of (a, b), as a column for each level of ``b``."""
    return rated.groupBy(F.col(a).alias("level")).agg(*[F.count_if(F.col(b) == v).alias(f"n_{v}") for v in range(low, high + 1)])


def direction_disagreement(rated: DataFrame, a: str, b: str, neutral: int) -> DataFrame:
    """One row: pairs of ratings, those that are two levels or more apart, and those on different sides of ``neutral``."""
    side = lambda c: F.signum(F.col(c).cast("double") - neutral)
    both = rated.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col(a) - F.col(b)) >= 2).alias("n_off_by_two"), F.count_if(side(a) != side(b)).alias("n_direction"))


def annotator_kappas(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """Kappa of every pair of raters over the items that both rated."""
    a = ratings.select(F.col(item).alias("i"), F.col(rater).alias("rater_a"), F.col(score).alias("a"))
    b = ratings.select(F.col(item).alias("i"), F.col(rater).alias("rater_b"), F.col(score).alias("b"))
    both = a.join(b, "i").where("rater_a < rater_b")
    return weighted_kappa(both, "a", "b", ["rater_a", "rater_b"])


def majority(ratings: DataFrame, item: str, score: str) -> DataFrame:
    """The most common score of each item; of equally common ones the lowest."""
    n = ratings.groupBy(item, score).agg(F.count("*").alias("n"))
    return n.groupBy(item).agg(F.max_by(score, F.struct("n", -F.col(score))).alias("majority"))


def panel(ratings: DataFrame, item: str, score: str, spread: int = 2) -> DataFrame:
    """Median of the judges' scores for each item, and whether they are ``spread`` or more apart."""
    return ratings.groupBy(item).agg(F.median(score).alias("panel_score"), (F.max(score) - F.min(score)).alias("spread"), ((F.max(score) - F.min(score)) >= spread).alias("contested"))


def two_proportions(rows: DataFrame, k1: str, n1: str, k2: str, n2: str, tests: int = 1) -> DataFrame:
    """Rows with z, Cohen's h, and the critical p of a Bonferroni correction for ``tests``."""
    p1, p2 = F.col(k1) / F.col(n1), F.col(k2) / F.col(n2)
    pool = (F.col(k1) + F.col(k2)) / (F.col(n1) + F.col(n2))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col(n1) + 1 / F.col(n2)))
    h = 2 * F.asin(F.sqrt(p2)) - 2 * F.asin(F.sqrt(p1))
    return rows.withColumns({"z": F.when(se > 0, (p2 - p1) / F.nullif(se, F.lit(0.0))), "cohen_h": h, "alpha": F.lit(0.05 / tests)})


def false_discovery(tests: DataFrame, p: str, rate: float = 0.05) -> DataFrame:
    """Benjamini and Hochberg's adjusted p, and whether it stays under ``rate``; any number of tests."""
    return ordered.false_discovery(tests, p, rate)


def sample_size(p1: Column, p2: Column, z_alpha: float = 1.959963984540054, z_power: float = 0.8416212335729143) -> Column:
    """Rows a side that a two-proportion test needs; null for equal proportions."""
    pool = (p1 + p2) / 2
    top = z_alpha * F.sqrt(2 * pool * (1 - pool)) + z_power * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return F.ceil(top * top / F.nullif((p1 - p2) * (p1 - p2), F.lit(0.0)))


def best_step(history: DataFrame, loss: str = "eval_loss", step: str = "step") -> DataFrame:
    """The step of least loss (the first of equals), the loss and its perplexity."""
    x = history.where(F.col(loss).isNotNull()).agg(F.min(F.struct(F.col(loss).alias("l"), F.col(step).alias("s"))).alias("b"))
    return x.select(F.col("b.s").alias("best_step"), F.col("b.l").alias("best_loss"), F.exp("b.l").alias("perplexity"))


def early_stop(history: DataFrame, patience: int, min_delta: float, loss: str = "eval_loss", step: str = "step", run: list[str] | None = None) -> DataFrame:
    """Evaluations up to the one at which ``patience`` in a row have not improved on the best by ``min_delta``; without ``run`` by ranges of steps."""
    if not run:
        return ordered.early_stop(history, patience, min_delta, loss, step)
    o = Window.partitionBy(*(run or [])).orderBy(step)
    best = F.min(loss).over(o.rowsBetween(Window.unboundedPreceding, -1))
    x = history.withColumn("improved", best.isNull() | (F.col(loss) < best - min_delta))
    x = x.withColumn("_g", F.sum(F.col("improved").cast("int")).over(o))
    x = x.withColumn("waited", F.row_number().over(Window.partitionBy(*(run or []), "_g").orderBy(step)) - 1)
    stop = F.min(F.when(F.col("waited") >= patience, F.col(step))).over(Window.partitionBy(*(run or [])))
    return x.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(step) <= F.col("_stop"))).drop("_g", "_stop")


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    number = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1)
    return paths.where(number != "").agg(F.max_by(path, number.cast("int")).alias("latest"))
