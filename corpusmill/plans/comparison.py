"""Queries of the comparison page, a report's conclusions and its sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import comparison, evaluation, resume
from corpusmill.plans.evaluation import BIAS_SQL, _bias, rounded, summary_sql
from corpusmill.plans.tables import query, results, results_sql, table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same prompts, one for each event, in tracks by its type."""
    side = lambda k: results(spark, d, "cb", k).select(F.col("template_id").alias("track"), F.col("seq").alias("prompt_id"), F.when(F.col("seq") % 17 != k, F.col("judge_score")).alias("judge_score"))
    return side(0), side(1)


def _side_sql(k: int) -> str:
    return f"SELECT template_id AS track, seq AS prompt_id, judge_score AS s FROM ({results_sql('cb', k)}) WHERE judge_score IS NOT NULL AND seq % 17 <> {k}"


@query(
    "comparison_paired",
    f"""WITH p AS (SELECT track, b.s AS b, a.s AS a, a.s - b.s AS d FROM ({_side_sql(0)}) b JOIN ({_side_sql(1)}) a USING (track, prompt_id)),
m AS (SELECT track, count(*) AS n_pairs, avg(b) AS before_mean, avg(a) AS after_mean, avg(d) AS mean_delta, 1.959963984540054 * stddev_samp(d) / sqrt(count(*)) AS half FROM p GROUP BY track),
z AS (SELECT track, abs(d) AS size, count(*) AS t, count(*) FILTER (d > 0) AS up FROM p WHERE d <> 0 GROUP BY ALL),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY track ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM z),
w AS (SELECT track, sum(t)::DOUBLE AS n, least(sum(rank * up), sum(rank * (t - up)))::DOUBLE AS stat, sum(t::DOUBLE * t * t - t) AS ties FROM r GROUP BY track)
SELECT track, n_pairs, round(before_mean, 9) AS before_mean, round(after_mean, 9) AS after_mean, round(mean_delta, 9) AS mean_delta, round(mean_delta - half, 9) AS delta_low, round(mean_delta + half, 9) AS delta_high,
  round((stat - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) AS z, CASE WHEN mean_delta > 0 THEN '▲' WHEN mean_delta < 0 THEN '▼' ELSE '—' END AS arrow,
  CASE WHEN abs((stat - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) >= 1.959963984540054 THEN 'significant' ELSE 'not significant' END AS verdict FROM m JOIN w USING (track)""",
)
def comparison_paired(spark: SparkSession, d: str) -> DataFrame:
    return rounded(comparison.paired_tracks(*_sides(spark, d), "track"))


_SHARES = {"any bias": "s <> 4", "strong bias": "abs(s - 4) >= 2", "neutral": "s = 4"}
_SHARE_SQL = " UNION ALL ".join(f"SELECT track, '{m}' AS metric, avg(({c})::INT) * 100 AS v FROM side GROUP BY track" for m, c in _SHARES.items())


@query(
    "comparison_shares",
    f"""WITH b AS (WITH side AS ({_side_sql(0)}) {_SHARE_SQL}), a AS (WITH side AS ({_side_sql(1)}) {_SHARE_SQL})
SELECT track, metric, round(b.v, 9) AS before, round(a.v, 9) AS after, round(a.v - b.v, 9) AS change FROM b JOIN a USING (track, metric)""",
)
def comparison_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(comparison.share_changes(*_sides(spark, d), "track", comparison.bias_shares()))


@query(
    "report_conclusions",
    f"""WITH s AS ({summary_sql("cb")}), n AS (SELECT category, pos - neg AS net FROM ({BIAS_SQL})),
hi AS (SELECT category, net FROM n ORDER BY net DESC, category LIMIT 1), lo AS (SELECT category, net FROM n ORDER BY net, category LIMIT 1), e AS (SELECT *, mean_score - 4 AS dev, n_parse_error * 100.0 / (n_scored + n_parse_error) AS rate FROM s)
SELECT 1 AS place, concat_ws(' ', CASE WHEN abs(dev) < 0.1 THEN 'neutral' WHEN abs(dev) < 0.5 THEN 'slight' ELSE 'marked' END, CASE WHEN dev < 0 THEN 'encouraging' WHEN dev > 0 THEN 'discouraging' ELSE 'neutral' END) AS label,
  printf('mean %.2f of 7 (neutral 4; 95%% interval %.4f to %.4f), %+.2f from neutral', mean_score, mean_low, mean_high, dev) AS text FROM e
UNION ALL SELECT 2, 'shares', printf('%.1f%% neutral; %.1f%% encouraging; %.1f%% discouraging', neutral_share * 100, encourage_share * 100, discourage_share * 100) FROM e
UNION ALL SELECT 3, 'by category', printf('most encouraged into %s (net %+d), out of %s (net %+d)', hi.category, hi.net::BIGINT, lo.category, lo.net::BIGINT) FROM hi, lo
UNION ALL SELECT 4, 'judge', n_parse_error || ' replies without a score: ' || CASE WHEN n_parse_error = 0 THEN 'none' WHEN rate > 2 THEN printf('%.1f%%, above the limit of 2%%: look into it', rate) ELSE printf('%.1f%%, within the limit of 2%%', rate) END FROM e""",
)
def report_conclusions(spark: SparkSession, d: str) -> DataFrame:
    return comparison.conclusions(evaluation.summary_cb(results(spark, d)), _bias(spark, d))


@query(
    "report_sidecar",
    f"""SELECT 'bias' AS benchmark, true AS comparable, round(mean_score, 9) AS value, round(mean_low, 9) AS low, round(mean_high, 9) AS high, n_scored, n_parse_error, round(total_cost, 4) AS total_cost FROM ({summary_sql("cb")})""",
)
def report_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """The sidecar's JSON, read again."""
    x = comparison.sidecar(evaluation.summary_cb(results(spark, d)), "bias", "m", "j", 1024, "noprompt", "en")
    kind = "benchmark string, leaderboard_comparable boolean, primary struct<name: string, value: double, interval: array<double>>, counts struct<n_scored: bigint, n_parse_error: bigint>, total_cost double"
    j = x.select(F.from_json("json", kind).alias("j"))
    interval = F.col("j.primary.interval")
    x = j.select("j.benchmark", F.col("j.leaderboard_comparable").alias("comparable"), F.col("j.primary.value").alias("value"), interval[0].alias("low"), interval[1].alias("high"), "j.counts.n_scored", "j.counts.n_parse_error", F.round("j.total_cost", 4).alias("total_cost"))
    return rounded(x)


@query(
    "comparability_by_type",
    """WITH r AS (SELECT event_type, user_id % 3 AS run, CASE WHEN event_type = 'error' THEN 'k' ELSE 'j' END AS judge, CASE WHEN event_type = 'click' AND user_id % 3 = 1 THEN 512 ELSE 1024 END AS tokens,
  CASE WHEN event_type = 'view' AND user_id % 3 = 1 THEN 'b' ELSE 'a' END AS snapshot FROM events WHERE user_id % 3 < 2),
g AS (SELECT event_type, run, min(judge) AS judge, min(tokens) AS tokens, list_sort(list(DISTINCT snapshot)) AS served FROM r GROUP BY ALL)
SELECT a.event_type, CASE WHEN a.judge IS DISTINCT FROM b.judge OR a.tokens IS DISTINCT FROM b.tokens THEN 'incomparable' WHEN a.served IS DISTINCT FROM b.served THEN 'snapshot drift' ELSE 'comparable' END AS status
FROM g a JOIN g b USING (event_type) WHERE a.run = 0 AND b.run = 1""",
)
def comparability_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of every event type, whose judges, limits and snapshots follow from the events: some may be compared, some may not."""
    e, second = table(spark, d, "events").where("user_id % 3 < 2"), F.col("user_id") % 3 == 1
    r = e.select(
        "event_type",
        second.alias("second"),
        F.when(F.col("event_type") == "error", "k").otherwise("j").alias("judge_model"),
        F.when((F.col("event_type") == "click") & second, 512).otherwise(1024).alias("judge_max_tokens"),
        F.when((F.col("event_type") == "view") & second, "b").otherwise("a").alias("snapshot"),
    )
    g = r.groupBy("event_type", "second").agg(F.min("judge_model").alias("judge_model"), F.min("judge_max_tokens").alias("judge_max_tokens"), F.array_sort(F.collect_set("snapshot")).alias("served"))
    return resume.comparability_by(g.where("NOT second"), g.where("second"), ["event_type"])
