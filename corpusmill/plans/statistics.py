"""Queries of paired tests, agreement and sampling for judge validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import sampling, stats
from corpusmill.plans.evaluation import Z, rounded
from corpusmill.plans.tables import LATEST_SQL, query, results, results_sql, table

PAIRS_SQL = f"""SELECT a.prompt_id, a.s AS before, b.s AS after, b.s - a.s AS delta
FROM ({LATEST_SQL.format(results_sql())}) a JOIN ({LATEST_SQL.format(results_sql("cb", 1))}) b USING (prompt_id)"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.pairs(results(spark, d), results(spark, d, side=1), seq="seq")


@query("score_pairs", PAIRS_SQL)
def score_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d)


@query(
    "paired_delta",
    f"""SELECT count(*) AS n_pairs, round(avg(before), 9) AS before_mean, round(avg(after), 9) AS after_mean, round(avg(delta), 9) AS mean_delta, round(coalesce(stddev_samp(delta), 0), 9) AS sd_delta,
  round(avg(delta) - {Z} * coalesce(stddev_samp(delta), 0) / sqrt(count(*)), 9) AS delta_low, round(avg(delta) + {Z} * coalesce(stddev_samp(delta), 0) / sqrt(count(*)), 9) AS delta_high,
  count(*) FILTER (delta > 0) AS n_improved, count(*) FILTER (delta < 0) AS n_worsened, count(*) FILTER (delta = 0) AS n_tied,
  round((count(*) FILTER (delta > 0) - count(*) FILTER (delta < 0)) * 1.0::DOUBLE / count(*) FILTER (delta <> 0), 9) AS rank_biserial FROM ({PAIRS_SQL})""",
)
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.paired_delta(pairs(spark, d)))


@query(
    "wilcoxon_parts",
    f"""WITH x AS (SELECT delta, abs(delta) AS a FROM ({PAIRS_SQL}) WHERE delta <> 0),
r AS (SELECT delta, a, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rk FROM x)
SELECT count(*) AS n, coalesce(sum(rk) FILTER (delta > 0), 0)::DOUBLE AS r_plus, coalesce(sum(rk) FILTER (delta < 0), 0)::DOUBLE AS r_minus,
  (SELECT coalesce(sum(t * t * t - t), 0)::BIGINT FROM (SELECT count(*) AS t FROM x GROUP BY a)) AS tie_term FROM r""",
)
def wilcoxon_parts(spark: SparkSession, d: str) -> DataFrame:
    return stats.signed_ranks(pairs(spark, d))


# n pairs of the test tables are over 50, so p is that of the normal approximation; erf by a series of positive terms
@query(
    "wilcoxon_test",
    f"""WITH x AS (SELECT delta, abs(delta) AS a FROM ({PAIRS_SQL}) WHERE delta <> 0),
r AS (SELECT delta, a, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rk FROM x),
s AS (SELECT count(*) AS n, least(coalesce(sum(rk) FILTER (delta > 0), 0), coalesce(sum(rk) FILTER (delta < 0), 0))::DOUBLE AS stat,
  (SELECT coalesce(sum(t * t * t - t), 0)::DOUBLE FROM (SELECT count(*) AS t FROM x GROUP BY a)) AS tie FROM r),
z AS (SELECT n, stat, abs(stat - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48) / sqrt(2.0::DOUBLE) AS v FROM s)
SELECT n, stat, round(CASE WHEN v = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-v * v) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(v) + 2 * k * ln(2.0::DOUBLE) + lgamma(k + 1.0::DOUBLE) - lgamma(2.0::DOUBLE * k + 2)))) END, 9) AS p FROM z""",
)
def wilcoxon_test(spark: SparkSession, d: str) -> DataFrame:
    """The finish needs the error function: Python on one row of sums."""
    got = stats.signed_ranks(pairs(spark, d)).first()
    w = stats.wilcoxon(got["n"], got["r_plus"], got["r_minus"], got["tie_term"])
    return rounded(spark.createDataFrame([(got["n"], w["stat"], w["p"])], "n long, stat double, p double"))


@query(
    "kappa",
    f"""WITH p AS (SELECT before::DOUBLE AS a, after::DOUBLE AS b FROM ({PAIRS_SQL})), n AS (SELECT count(*) AS n FROM p),
o AS (SELECT sum((a - b) * (a - b)) AS num FROM p), ra AS (SELECT a, count(*) AS c FROM p GROUP BY a), rb AS (SELECT b, count(*) AS c FROM p GROUP BY b),
e AS (SELECT sum((a - b) * (a - b) * ra.c * rb.c) / (SELECT n FROM n) AS den FROM ra, rb) SELECT n, round(1 - num / den, 9) AS kappa FROM n, o, e""",
)
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.weighted_kappa(pairs(spark, d), "before", "after"))


@query(
    "agreement_bands",
    """SELECT count(*) AS n, round(avg((quality = toxic)::INT), 9) AS exact, round(avg((abs(quality - toxic) <= 1)::INT), 9) AS within_one, round(avg(quality - toxic), 9) AS mean_difference,
  count(DISTINCT quality) < 2 OR count(DISTINCT toxic) < 2 AS degenerate FROM labels""",
)
def agreement_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.agreement(table(spark, d, "labels"), "quality", "toxic", 0, 1).select("n", "exact", "within_one", "mean_difference", "degenerate"))


@query("confusion_matrix", f"SELECT before AS level, {', '.join(f'count(*) FILTER (after = {v}) AS n_{v}' for v in range(1, 8))} FROM ({PAIRS_SQL}) GROUP BY before")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(pairs(spark, d), "before", "after", 1, 7)


RATERS_SQL = "SELECT prompt_id, template_id AS rater, max(judge_score) AS s FROM ({0}) WHERE judge_score IS NOT NULL GROUP BY 1, 2".format(results_sql())


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("judge_score IS NOT NULL").groupBy("prompt_id", F.col("template_id").alias("rater")).agg(F.max("judge_score").alias("s"))


@query(
    "annotator_kappas",
    f"""WITH r AS ({RATERS_SQL}), p AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.s::DOUBLE AS x, b.s::DOUBLE AS y FROM r a JOIN r b ON a.prompt_id = b.prompt_id AND a.rater < b.rater)
SELECT rater_a, rater_b, count(*) AS n, round(CASE WHEN sum(x*x) + sum(y*y) - 2 * sum(x) * sum(y) / count(*) = 0 THEN 1 ELSE 1 - sum((x-y)*(x-y)) / (sum(x*x) + sum(y*y) - 2 * sum(x) * sum(y) / count(*)) END, 9) AS kappa FROM p GROUP BY 1, 2""",
)
def annotator_kappas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.annotator_kappas(_ratings(spark, d), "prompt_id", "rater", "s"))


@query("majority_score", f"SELECT prompt_id, arg_max(s, n * 100 - s) AS majority FROM (SELECT prompt_id, judge_score AS s, count(*) AS n FROM ({results_sql()}) WHERE judge_score IS NOT NULL GROUP BY 1, 2) GROUP BY prompt_id")
def majority_score(spark: SparkSession, d: str) -> DataFrame:
    return stats.majority(results(spark, d).where("judge_score IS NOT NULL"), "prompt_id", "judge_score")


@query("judge_panel", f"SELECT prompt_id, median(s) AS panel_score, max(s) - min(s) AS spread, max(s) - min(s) >= 2 AS contested FROM ({RATERS_SQL}) GROUP BY prompt_id")
def judge_panel(spark: SparkSession, d: str) -> DataFrame:
    return stats.panel(_ratings(spark, d), "prompt_id", "s")


@query("dispute_levels", f"SELECT prompt_id, max(s) - min(s) AS spread, CASE WHEN min(s) = max(s) THEN 'none' WHEN min(s) >= 4 THEN 'minor' WHEN max(s) >= 4 THEN 'moderate' ELSE 'rejected' END AS dispute FROM ({RATERS_SQL}) GROUP BY prompt_id")
def dispute_levels(spark: SparkSession, d: str) -> DataFrame:
    from corpusmill.operators.curation import dispute_level

    return dispute_level(_ratings(spark, d), "prompt_id", "s", 4).select("prompt_id", "spread", "dispute")


@query(
    "stratified_sample",
    f"""WITH s AS ({LATEST_SQL.format(results_sql())}), m AS (SELECT arg_max(s, n * 1000000000 - first) AS modal FROM (SELECT s, count(*) AS n, min(prompt_id) AS first FROM s GROUP BY s)),
r AS (SELECT prompt_id, s, s = (SELECT modal FROM m) AS is_modal, row_number() OVER (PARTITION BY s = (SELECT modal FROM m) ORDER BY sha256('42:' || prompt_id), prompt_id) AS rk FROM s),
c AS (SELECT count(*) FILTER (is_modal) AS nm, count(*) FILTER (NOT is_modal) AS no FROM r),
k AS (SELECT least(no, greatest(20, 40 - nm)) AS n_other, least(nm, 40 - least(no, greatest(20, 40 - nm))) AS n_modal FROM c)
SELECT prompt_id, s AS judge_score, is_modal FROM r, k WHERE rk <= CASE WHEN is_modal THEN n_modal ELSE n_other END""",
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    latest = results(spark, d).where("judge_score IS NOT NULL").groupBy("prompt_id").agg(F.max_by("judge_score", "seq").alias("judge_score"))
    return sampling.modal_sample(latest, "judge_score", "prompt_id", 40)


@query("blind_template", f"SELECT prompt_id, NULL::INT AS human_score, '1-7' AS _scale FROM ({LATEST_SQL.format(results_sql())})")
def blind_template(spark: SparkSession, d: str) -> DataFrame:
    latest = results(spark, d).where("judge_score IS NOT NULL").groupBy("prompt_id").agg(F.max_by("judge_score", "seq").alias("judge_score"))
    return sampling.blind_template(latest, 1, 7)[0]


@query(
    "bh_fdr",
    """WITH t AS (SELECT user_id, (min(event_id) % 997 + 1) / 1000.0::DOUBLE AS p FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY p, user_id) AS rk, count(*) OVER () AS m FROM t)
SELECT user_id, round(min(least(1.0, p * m / rk)) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 9) AS q FROM r""",
)
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("user_id").agg(((F.min("event_id") % 997 + 1) / 1000.0).alias("p"))
    return rounded(stats.false_discovery(t, "p").select("user_id", "q"))


@query(
    "two_proportions",
    """WITH c AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS n1, count(*) FILTER (user_id % 2 = 0 AND value > 20) AS k1, count(*) FILTER (user_id % 2 = 1) AS n2, count(*) FILTER (user_id % 2 = 1 AND value > 20) AS k2 FROM events GROUP BY 1)
SELECT event_type, round((k2 / n2 - k1 / n1) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)), 9) AS z,
  round(2 * asin(sqrt(k2 / n2)) - 2 * asin(sqrt(k1 / n1)), 9) AS cohen_h FROM c""",
)
def two_proportions(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.count_if(F.col("user_id") % 2 == k)
    hit = lambda k: F.count_if((F.col("user_id") % 2 == k) & (F.col("value") > 20))
    c = table(spark, d, "events").groupBy("event_type").agg(side(0).alias("n1"), hit(0).alias("k1"), side(1).alias("n2"), hit(1).alias("k2"))
    return rounded(stats.two_proportions(c, "k1", "n1", "k2", "n2", 5).select("event_type", "z", "cohen_h"))


@query("best_step", "SELECT arg_min(event_id, value * 10000000 + event_id) AS best_step, min(value) AS best_loss, round(exp(min(value)), 9) AS perplexity FROM events WHERE event_type = 'view'")
def best_step(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.best_step(table(spark, d, "events").where("event_type = 'view'"), "value", "event_id"))


@query(
    "early_stop",
    """WITH e AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
i AS (SELECT *, best IS NULL OR value < best - 0.5 AS improved FROM e), g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM i),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS waited FROM g), s AS (SELECT user_id, min(event_id) FILTER (waited >= 3) AS stop FROM w GROUP BY user_id)
SELECT w.user_id, event_id, waited::INT AS waited FROM w JOIN s USING (user_id) WHERE stop IS NULL OR event_id <= stop""",
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return stats.early_stop(table(spark, d, "events").select("user_id", "event_id", "value"), 3, 0.5, "value", "event_id", ["user_id"]).select("user_id", "event_id", "waited")


@query("latest_checkpoint", "SELECT 'run/checkpoint-' || max(event_id) AS latest FROM events")
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return stats.latest_checkpoint(table(spark, d, "events").select(F.concat(F.lit("run/checkpoint-"), F.col("event_id").cast("string")).alias("path")))


@query(
    "power_analysis",
    """WITH t AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0 AND value > 20) / count(*) FILTER (user_id % 2 = 0) AS p1, count(*) FILTER (user_id % 2 = 1 AND value > 60) / count(*) FILTER (user_id % 2 = 1) AS p2 FROM events GROUP BY event_type),
q AS (SELECT *, (p1 + p2) / 2 AS m FROM t WHERE p1 <> p2)
SELECT event_type, ceil(pow(1.959963984540054::DOUBLE * sqrt(2 * m * (1 - m)) + 0.8416212335729143::DOUBLE * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / pow(p1 - p2, 2))::BIGINT AS n_per_side FROM q""",
)
def power_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Rows a side that would tell apart, for each event type, the share of large values of even users from that of very large ones of odd users."""
    share = lambda k, most: F.count_if((F.col("user_id") % 2 == k) & (F.col("value") > most)) / F.count_if(F.col("user_id") % 2 == k)
    x = table(spark, d, "events").groupBy("event_type").agg(share(0, 20).alias("p1"), share(1, 60).alias("p2")).where("p1 <> p2")
    return x.select("event_type", stats.sample_size(F.col("p1"), F.col("p2")).alias("n_per_side"))
