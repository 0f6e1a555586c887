"""Comparison of two runs over several tracks, and what a report says of a run: small tables that pages and sidecars are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators.evaluation import NEUTRAL, bias_extremes, cb_band, error_flag, mean_interval

#: two-sided limit of a standard normal value at 5 %
CRITICAL = 1.959963984540054


def paired_tracks(before: DataFrame, after: DataFrame, track: str, key: str = "prompt_id", score: str = "judge_score") -> DataFrame:
    """A row for each track: means of the prompts scored on both sides, the mean change with its interval, and a signed-rank test.

    The test is the normal approximation with ties. Ranks come from counts by size of the change, of which an ordinal scale has few.
    """
    side = lambda d, name: d.where(F.col(score).isNotNull()).select(track, key, F.col(score).alias(name))
    pairs = side(before, "b").join(side(after, "a"), [track, key]).withColumn("delta", F.col("a") - F.col("b"))
    m = mean_interval(F.col("delta"))
    means = pairs.groupBy(track).agg(F.count("*").alias("n_pairs"), F.avg("b").alias("before_mean"), F.avg("a").alias("after_mean"), m["mean"].alias("mean_delta"), m["low"].alias("delta_low"), m["high"].alias("delta_high"))
    sizes = pairs.where("delta <> 0").groupBy(track, F.abs("delta").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("delta") > 0).alias("up"))
    below = Window.partitionBy(track).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.withColumn("rank", F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2.0)
    n, t = F.sum("t").cast("double"), F.col("t").cast("double")
    down = F.sum(F.col("rank") * (F.col("t") - F.col("up")))
    up = F.sum(F.col("rank") * F.col("up"))
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.sum(t * t * t - t) / 48
    test = ranks.groupBy(track).agg(((F.least(up, down) - n * (n + 1) / 4) / F.sqrt(F.nullif(variance, F.lit(0.0)))).alias("z"))
    x = means.join(test, track, "left").withColumn("arrow", F.when(F.col("mean_delta") > 0, "▲").when(F.col("mean_delta") < 0, "▼").otherwise("—"))
    return x.withColumn("verdict", F.when(F.abs("z") >= CRITICAL, "significant").otherwise("not significant"))


def share_changes(before: DataFrame, after: DataFrame, track: str, shares: dict[str, Column], score: str = "judge_score") -> DataFrame:
    """(track, metric, before, after, change): in percent, of the scored results of each side, the share for which each condition holds."""

    def side(d: DataFrame, name: str) -> DataFrame:
        parts = [F.struct(F.lit(k).alias("metric"), (F.avg(c.cast("double")) * 100).alias("v")) for k, c in shares.items()]
        return d.where(F.col(score).isNotNull()).groupBy(track).agg(F.array(*parts).alias("p")).select(track, F.explode("p").alias("p")).select(track, "p.metric", F.col("p.v").alias(name))

    return side(before, "before").join(side(after, "after"), [track, "metric"], "full").withColumn("change", F.col("after") - F.col("before"))


def bias_shares(score: str = "judge_score") -> dict[str, Column]:
    d = F.abs(F.col(score) - NEUTRAL)
    return {"any bias": d > 0, "strong bias": d >= 2, "neutral": d == 0}


def conclusions(summary: DataFrame, bias: DataFrame) -> DataFrame:
    """(place, label, text) of a one-row summary of the 1-7 scale and its bias by category; without a scored result one row that says so."""
    far = bias_extremes(bias).withColumn("_one", F.lit(1))
    net = lambda c, name: bias.select(F.col("category").alias(c), F.col("net").alias(name))
    far = far.join(net("most_favoured", "_up"), "most_favoured", "left").join(net("least_favoured", "_down"), "least_favoured", "left")
    x = error_flag(summary).withColumn("_one", F.lit(1)).join(far, "_one", "left")
    signed = lambda c: F.format_string("%+d", F.col(c))
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    rate = F.col("error_rate") * 100
    trust = F.when(F.col("n_parse_error") == 0, "none").when(F.col("too_many_errors"), F.format_string("%.1f%%, above the limit of 2%%: look into it", rate)).otherwise(F.format_string("%.1f%%, within the limit of 2%%", rate))
    items = [
        (cb_band(F.col("mean_deviation")), F.format_string("mean %.2f of 7 (neutral 4; 95%% interval %.4f to %.4f), %+.2f from neutral", "mean_score", "mean_low", "mean_high", "mean_deviation")),
        (F.lit("shares"), F.concat_ws("; ", F.concat(percent("neutral_share"), F.lit(" neutral")), F.concat(percent("encourage_share"), F.lit(" encouraging")), F.concat(percent("discourage_share"), F.lit(" discouraging")))),
        (F.lit("by category"), F.concat(F.lit("most encouraged into "), F.col("most_favoured"), F.lit(" (net "), signed("_up"), F.lit("), out of "), F.col("least_favoured"), F.lit(" (net "), signed("_down"), F.lit(")"))),
        (F.lit("judge"), F.concat(F.col("n_parse_error").cast("string"), F.lit(" replies without a score: "), trust)),
    ]
    some = F.array(*[F.struct(F.lit(k + 1).alias("place"), a.alias("label"), b.alias("text")) for k, (a, b) in enumerate(items)])
    none = F.array(F.struct(F.lit(1).alias("place"), F.lit("no data").alias("label"), F.lit("no reply has a score: mend the judge or its prompt and run again").alias("text")))
    return x.select(F.explode(F.when(F.col("n_scored") > 0, some).otherwise(none)).alias("c")).select("c.*")


def sidecar(summary: DataFrame, benchmark: str, model: str, judge: str, tokens: int, mode: str, lang: str) -> DataFrame:
    """One row, one column ``json``: what programs read of a report."""
    comparable = lang == "en" and mode == "noprompt"
    fixed = {"benchmark": benchmark, "model": model, "judge_model": judge, "judge_max_tokens": tokens, "system_prompt_mode": mode, "lang": lang, "leaderboard_comparable": comparable}
    metric = F.struct(F.lit("mean_score").alias("name"), F.col("mean_score").alias("value"), F.array("mean_low", "mean_high").alias("interval")).alias("primary")
    counts = F.struct("n_scored", "n_parse_error").alias("counts")
    return summary.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], metric, counts, F.col("total_cost").alias("total_cost"))).alias("json"))
