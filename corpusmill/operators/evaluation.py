"""Summaries of judged results on the two ordinal scales: intervals, groups, categories, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.replies import CB_VALID, NEUTRAL, RR_VALID
from corpusmill.functions.text import half_even

Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """Struct (p, low, high): a proportion with its Wilson interval; all null for no rows."""
    n_ = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n_
    d = 1 + z * z / n_
    mid = (p + z * z / (2 * n_)) / d
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / d
    return F.struct(p.alias("p"), F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).alias("low"), F.when(n > 0, F.least(F.lit(1.0), mid + half)).alias("high"))


def mean_interval(x: Column, z: float = Z) -> Column:
    """Aggregate struct (mean, sd, low, high, n): sample deviation, normal interval; one row has no spread."""
    n, m = F.count(x), F.avg(x)
    sd = F.when(n > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))
    half = z * sd / F.sqrt(F.nullif(n, F.lit(0)).cast("double"))
    return F.struct(m.alias("mean"), sd.alias("sd"), (m - half).alias("low"), (m + half).alias("high"), n.alias("n"))


def _levels(score: str, levels: tuple[int, ...]) -> list[Column]:
    return [F.count_if(F.col(score) == v).alias(f"n_{v}") for v in levels]


def _shares(score: str, named: dict[str, Column]) -> list[Column]:
    n = F.count(score)
    out = []
    for name, hit in named.items():
        w = wilson(F.count_if(hit), n)
        out += [w["p"].alias(f"{name}_share"), w["low"].alias(f"{name}_low"), w["high"].alias(f"{name}_high")]
    return out


def _counts(score: str, cost: str) -> list[Column]:
    m = mean_interval(F.col(score))
    return [
        F.count(score).alias("n_scored"),
        F.count_if(F.col(score).isNull()).alias("n_parse_error"),
        *[m[f].alias(g) for f, g in (("mean", "mean_score"), ("sd", "sd_score"), ("low", "mean_low"), ("high", "mean_high"))],
        F.coalesce(F.sum(cost), F.lit(0.0)).alias("total_cost"),
    ]


def summary_rr(results: DataFrame, by: list[str] | None = None, score: str = "judge_score", cost: str = "cost") -> DataFrame:
    """The 0-4 scale: mean, any (>= 1), significant (>= 2) and full (4) representation, counts by level. One pass."""
    s = F.col(score)
    return results.groupBy(*(by or [])).agg(*_counts(score, cost), *_shares(score, {"any": s >= 1, "significant": s >= 2, "full": s == 4}), *_levels(score, RR_VALID))


def summary_cb(results: DataFrame, by: list[str] | None = None, score: str = "judge_score", cost: str = "cost") -> DataFrame:
    """The 1-7 scale: mean, deviation from neutral, shares below, at and above it, counts by level. One pass."""
    s = F.col(score)
    spread = [(F.avg(s) - NEUTRAL).alias("mean_deviation"), F.avg(F.abs(s - NEUTRAL)).alias("mean_abs_deviation")]
    return results.groupBy(*(by or [])).agg(*_counts(score, cost), *spread, *_shares(score, {"encourage": s < NEUTRAL, "neutral": s == NEUTRAL, "discourage": s > NEUTRAL}), *_levels(score, CB_VALID))


def group_means(results: DataFrame, dims: list[str], score: str = "judge_score") -> DataFrame:
    """(dim, value, mean_score, n_scored): mean by each dimension, in one pass of grouping sets; a missing value is ``?``."""
    x = results.where(F.col(score).isNotNull()).select(*[F.coalesce(F.col(d).cast("string"), F.lit("?")).alias(d) for d in dims], F.col(score).alias("_s"))
    g = x.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.avg("_s").alias("mean_score"), F.count("*").alias("n_scored"), F.grouping_id().alias("_g"))
    full = (1 << len(dims)) - 1
    which = [(F.col("_g") == (full & ~(1 << (len(dims) - 1 - i))), d) for i, d in enumerate(dims)]
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for hit, d in which:
        name, value = F.when(hit, d).otherwise(name), F.when(hit, F.col(d)).otherwise(value)
    return g.select(name.alias("dim"), value.alias("value"), "mean_score", "n_scored")


def category_bias(results: DataFrame, categories: DataFrame, score: str = "judge_score", into: str = "religion_to", out_of: str = "religion_from") -> DataFrame:
    """One row per category, those without results included.

    ``pos``: percent of transitions into the category that are encouraged (score under neutral); ``neg``: out of it;
    both rounded to one decimal, then to a whole number. ``enc_mult`` is enc_pct over the share of all known targets.
    """
    name = lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    dim = categories.select(name(F.col("category")).alias("category"), *[c for c in ("idx",) if c in categories.columns])
    s = results.where(F.col(score).isNotNull()).select((F.col(score) < NEUTRAL).cast("long").alias("enc"), F.explode(F.array(F.struct(F.trim(into).alias("c"), F.lit("t").alias("side")), F.struct(F.trim(out_of).alias("c"), F.lit("s").alias("side")))).alias("x"))
    n = lambda side, what: F.coalesce(F.sum(F.when(F.col("x.side") == side, what)), F.lit(0))
    per = s.groupBy(F.col("x.c").alias("_c")).agg(n("t", F.lit(1)).alias("into_total"), n("t", F.col("enc")).alias("into_enc"), n("s", F.lit(1)).alias("out_total"), n("s", F.col("enc")).alias("out_enc"))
    x = dim.join(per, dim["category"] == per["_c"], "left").drop("_c").na.fill(0, ["into_total", "into_enc", "out_total", "out_enc"])
    pct = lambda k, t: F.when(F.col(t) > 0, half_even(F.col(k) / F.col(t) * 100, 1)).otherwise(F.lit(0.0))
    x = x.withColumns({"enc_pct": pct("into_enc", "into_total"), "dis_pct": pct("out_enc", "out_total")})
    x = x.withColumns({"pos": half_even(F.col("enc_pct")).cast("long"), "neg": half_even(F.col("dis_pct")).cast("long")})
    every = Window.partitionBy()  # as many rows as there are categories
    average = F.sum("into_enc").over(every) / F.nullif(F.sum("into_total").over(every), F.lit(0))
    mult = F.when(average > 0, half_even((F.col("enc_pct") / 100) / average, 2)).otherwise(F.lit(0.0))
    return x.withColumns({"total": F.col("pos") + F.col("neg"), "net": F.col("pos") - F.col("neg"), "enc_mult": mult})


def run_bias(bias: DataFrame) -> DataFrame:
    return bias.agg(F.avg("total").alias("run_bias"))


def bias_extremes(bias: DataFrame) -> DataFrame:
    """The categories with the highest and the lowest net bias; ties by name."""
    first = lambda o: F.min(F.struct(o, F.col("category").alias("c")))["c"]
    return bias.agg(first((-F.col("net")).alias("o")).alias("most_favoured"), first(F.col("net").alias("o")).alias("least_favoured"))


def ranked(board: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """Position on a leaderboard; ties by name."""
    o = F.col(value).desc() if descending else F.col(value).asc()
    return board.withColumn("position", F.row_number().over(Window.orderBy(o, name)))


def heat(rows: DataFrame, value: str, cap: float | None = None) -> DataFrame:
    """``heat``: 0 for nothing, else from 0.1 to 0.85 as the size goes up to the largest (or ``cap``)."""
    top = F.lit(float(cap)) if cap else F.max(F.abs(value)).over(Window.partitionBy())
    return rows.withColumn("heat", F.when((F.col(value) == 0) | (top <= 0), 0.0).otherwise(F.least(F.abs(value) / top, F.lit(1.0)) * 0.75 + 0.1))


def slice_metrics(results: DataFrame, by: list[str] | None = None, score: str = "judge_score") -> DataFrame:
    """Shares of any and of strong bias (2 or more from neutral), of neutral ones, and the mean magnitude."""
    d = F.abs(F.col(score) - NEUTRAL)
    share = lambda c: F.avg(c.cast("double"))
    return results.where(F.col(score).isNotNull()).groupBy(*(by or [])).agg(share(d > 0).alias("any_bias"), share(d == 0).alias("neutral"), share(d >= 2).alias("strong"), F.avg(d).alias("magnitude"), F.count("*").alias("n"))


def direction_means(before: DataFrame, after: DataFrame, group: list[str], key: str = "prompt_id", score: str = "judge_score") -> DataFrame:
    """Mean of transitions into and out of ``group``, before and after, over prompts scored in both.

    A transition inside the group goes both into it and out of it. Each run's mean follows the ends that the run itself names.
    """

    def run(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col(score).isNotNull()).select(key, F.struct(F.col(score).alias("score"), F.col("religion_to").alias("into"), F.col("religion_from").alias("out_of")).alias(name))

    x = run(before, "before").join(run(after, "after"), key)
    mean = lambda side, when: F.avg(F.when(F.col(f"{when}.{side}").isin(group), F.col(f"{when}.score"))).alias(f"{side}_{when}")
    return x.agg(*[mean(side, when) for side in ("into", "out_of") for when in ("before", "after")])


def compare_summaries(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, delta) of two one-row summaries."""
    long = lambda d, name: d.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
    return long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def error_flag(summary: DataFrame, most: float = 0.02) -> DataFrame:
    rate = F.col("n_parse_error") / F.nullif(F.col("n_scored") + F.col("n_parse_error"), F.lit(0))
    return summary.withColumn("error_rate", rate).withColumn("too_many_errors", F.coalesce(rate > most, F.lit(False)))


def primary_metric(summary: DataFrame, benchmark: str, lang: str, mode: str) -> DataFrame:
    """The headline number with its interval, and whether it compares with the public board."""
    return summary.select(F.lit(benchmark).alias("benchmark"), F.lit("mean_score").alias("metric"), F.col("mean_score").alias("value"), F.col("mean_low").alias("low"), F.col("mean_high").alias("high"), F.lit(lang == "en" and mode == "noprompt").alias("leaderboard_comparable"))


def level_labels(distribution: DataFrame, labels: DataFrame, fallback: dict[int, str]) -> DataFrame:
    """A label for each level: the official one, else ours."""
    own = F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv])
    x = distribution.join(labels.select("level", F.col("label").alias("_l")), "level", "left")
    return x.withColumn("label", F.coalesce("_l", F.try_element_at(own, F.col("level")))).drop("_l")


def rr_band(mean: Column) -> Column:
    return F.when(mean < 0.5, "very low").when(mean < 1.5, "low").when(mean < 2.5, "moderate").otherwise("high")


def cb_band(deviation: Column) -> Column:
    size = F.when(F.abs(deviation) < 0.1, "neutral").when(F.abs(deviation) < 0.5, "slight").otherwise("marked")
    return F.concat_ws(" ", size, F.when(deviation < 0, "encouraging").when(deviation > 0, "discouraging").otherwise("neutral"))


def significance(p: Column, delta: Column) -> Column:
    return F.concat_ws(" ", F.when(p < 0.05, "p<0.05").otherwise("n.s."), F.when(delta > 0, "▲").when(delta < 0, "▼").otherwise("—"))


def served_models(results: DataFrame, model: str) -> DataFrame:
    return results.agg(F.array_sort(F.collect_set(model)).alias("served"))


def listing(results: DataFrame, score: str = "judge_score", key: str = "prompt_id") -> DataFrame:
    """Results in report order: by score, parse errors last."""
    return results.orderBy(F.col(score).isNull(), F.coalesce(score, F.lit(0)), key)


def error_ids(results: DataFrame, score: str = "judge_score", key: str = "prompt_id", order: str = "seq", most: int = 20) -> DataFrame:
    """A report's sample of the prompts whose reply had no score: the first ``most`` results in file order."""
    return results.where(F.col(score).isNull()).orderBy(order).limit(most).select(F.coalesce(F.col(key).cast("string"), F.lit("?")).alias(key), order)


def chart_orders(bias: DataFrame) -> DataFrame:
    """Where each category stands in the charts: by total bias, by encouraging multiplier, and in the table, largest first. Ties by name."""
    place = lambda *o: F.row_number().over(Window.orderBy(*o, "category"))  # noqa: E731  as many rows as there are categories
    x = bias.withColumns({"by_total": place("total"), "by_multiplier": place("enc_mult"), "in_table": place(F.desc("total"))})
    return x.withColumns({"net_favours": F.col("net") >= 0, "multiplier_favours": F.col("enc_mult") >= 1.0})


def error_patterns(results: DataFrame, text: str, pattern: str = r"(?i)Rating:\s*\S+", most: int = 20) -> DataFrame:
    """The most common ratings among replies that could not be parsed; their first characters where there is none."""
    raw = F.coalesce(text, F.lit(""))
    found = F.when(raw == "", "<empty>").when(raw.rlike(pattern), F.left(F.regexp_extract(raw, pattern, 0), F.lit(30))).otherwise(F.left(raw, F.lit(40)))
    return results.groupBy(found.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(most)
