"""Queries of judged evaluations: resume, summaries, bias, ranks, reply parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import replies as P
from corpusmill.functions import text as X
from corpusmill.operators import curation, dedup, evaluation, records, resume
from corpusmill.plans.tables import LATEST_SQL, TRANSITIONS_SQL, query, results, results_sql, table, transitions

Z = evaluation.Z


def wilson_sql(k: str, n: str) -> tuple[str, str, str]:
    p = f"({k}) * 1.0::DOUBLE / nullif({n}, 0)"
    d = f"(1 + {Z} * {Z} / ({n}))"
    mid = f"(({p}) + {Z} * {Z} / (2.0 * ({n}))) / {d}"
    half = f"{Z} * sqrt(({p}) * (1 - ({p})) / ({n}) + {Z} * {Z} / (4.0 * ({n}) * ({n}))) / {d}"
    return p, f"CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, {mid} - {half}) END", f"CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, {mid} + {half}) END"


def rounded(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles at nine decimals, so that the order of a sum does not show."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


def summary_sql(scale: str, by: str = "") -> str:
    shares = {"any": "s >= 1", "significant": "s >= 2", "full": "s = 4"} if scale == "rr" else {"encourage": "s < 4", "neutral": "s = 4", "discourage": "s > 4"}
    levels = range(5) if scale == "rr" else range(1, 8)
    cols = [by] if by else []
    cols += ["count(s) AS n_scored", "count(*) FILTER (s IS NULL) AS n_parse_error", "round(avg(s), 9) AS mean_score", "CASE WHEN count(s) > 0 THEN round(coalesce(stddev_samp(s), 0), 9) END AS sd_score"]
    half = f"{Z} * coalesce(stddev_samp(s), 0) / sqrt(count(s))"
    cols += [f"round(avg(s) - {half}, 9) AS mean_low", f"round(avg(s) + {half}, 9) AS mean_high", "round(coalesce(sum(cost), 0), 9) AS total_cost"]
    if scale == "cb":
        cols += ["round(avg(s) - 4, 9) AS mean_deviation", "round(avg(abs(s - 4)), 9) AS mean_abs_deviation"]
    for name, hit in shares.items():
        p, low, high = wilson_sql(f"count(*) FILTER ({hit})", "count(s)")
        cols += [f"round({p}, 9) AS {name}_share", f"round({low}, 9) AS {name}_low", f"round({high}, 9) AS {name}_high"]
    cols += [f"count(*) FILTER (s = {v}) AS n_{v}" for v in levels]
    return f"SELECT {', '.join(cols)} FROM (SELECT *, judge_score AS s FROM ({results_sql(scale)}))" + (f" GROUP BY {by}" if by else "")


@query("summary_rr", summary_sql("rr"))
def summary_rr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.summary_rr(results(spark, d, "rr")))


@query("summary_cb", summary_sql("cb"))
def summary_cb(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.summary_cb(results(spark, d)))


@query("summary_cb_by_template", summary_sql("cb", "template_id"))
def summary_cb_by_template(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.summary_cb(results(spark, d), ["template_id"]))


@query(
    "group_means",
    f"""WITH r AS (SELECT coalesce(pair_id, '?') AS pair_id, coalesce(template_id, '?') AS template_id, judge_score AS s FROM ({results_sql()}) WHERE judge_score IS NOT NULL)
SELECT 'pair_id' AS dim, pair_id AS value, round(avg(s), 9) AS mean_score, count(*) AS n_scored FROM r GROUP BY pair_id
UNION ALL SELECT 'template_id', template_id, round(avg(s), 9), count(*) FROM r GROUP BY template_id""",
)
def group_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.group_means(results(spark, d), ["pair_id", "template_id"]))


@query(
    "group_means_religion",
    f"""WITH r AS MATERIALIZED (SELECT religion_from AS f, religion_to AS t, judge_score AS s FROM ({TRANSITIONS_SQL}) WHERE judge_score IS NOT NULL)
SELECT 'religion_from' AS dim, f AS value, round(avg(s), 9) AS mean_score, count(*) AS n_scored FROM r GROUP BY f
UNION ALL SELECT 'religion_to', t, round(avg(s), 9), count(*) FROM r GROUP BY t""",
)
def group_means_religion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.group_means(transitions(spark, d), ["religion_from", "religion_to"]))


DEDUP_SQL = f"""SELECT prompt_id, arg_max({{'seq': seq, 's': judge_score}}, (CASE WHEN judge_score IS NULL THEN 0 ELSE 1 END) * 100000000000 + seq) AS r, min(seq) AS pos
FROM ({results_sql()}) GROUP BY prompt_id"""


@query("scores_dedup_prefer_valid", f"SELECT prompt_id, r.seq AS seq, r.s AS judge_score, pos FROM ({DEDUP_SQL})")
def scores_dedup_prefer_valid(spark: SparkSession, d: str) -> DataFrame:
    return dedup.prefer_valid(results(spark, d).select("prompt_id", "seq", "judge_score"))


# the prompts of the next three: seven numbers apart, so that some have no result; those that 5 divides have no score in any
NEXT_SQL = f"SELECT prompt_id, CASE WHEN prompt_id % 5 <> 0 THEN judge_score END AS judge_score FROM ({results_sql()})"


def _next(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    done = results(spark, d).withColumn("judge_score", F.when(F.col("prompt_id") % 5 != 0, F.col("judge_score")))
    return table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("prompt_id")), done


@query("remaining_prompts", f"SELECT item_id * 7 AS prompt_id FROM benchmark WHERE item_id * 7 NOT IN (SELECT prompt_id FROM ({NEXT_SQL}) WHERE judge_score IS NOT NULL)")
def remaining_prompts(spark: SparkSession, d: str) -> DataFrame:
    return resume.remaining(*_next(spark, d))


@query(
    "pending_parse",
    f"""WITH r AS ({NEXT_SQL}) SELECT item_id * 7 AS prompt_id FROM benchmark
WHERE item_id * 7 IN (SELECT prompt_id FROM r) AND item_id * 7 NOT IN (SELECT prompt_id FROM r WHERE judge_score IS NOT NULL)""",
)
def pending_parse(spark: SparkSession, d: str) -> DataFrame:
    return resume.pending_parse(*_next(spark, d))


@query(
    "budget_prefix",
    f"""SELECT prompt_id, seq FROM (SELECT prompt_id, seq, sum(cost::DECIMAL(18,2)) OVER (PARTITION BY prompt_id ORDER BY seq) AS spent FROM ({results_sql()})) WHERE spent <= 500""",
)
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    x = results(spark, d).withColumn("cost", F.col("cost").cast("decimal(18,2)"))
    return resume.within_budget(x, "cost", "seq", 500, ["prompt_id"]).select("prompt_id", "seq")


@query("total_spend", f"SELECT sum(cost::DECIMAL(18,2))::DOUBLE AS spend FROM ({results_sql()})")
def total_spend(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).agg(F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("spend"))


BIAS_SQL = f"""WITH t AS MATERIALIZED ({TRANSITIONS_SQL}), r AS (SELECT (judge_score < 4)::INT AS e, trim(religion_to) AS t, trim(religion_from) AS f FROM t WHERE judge_score IS NOT NULL),
i AS (SELECT t, count(*) AS n, sum(e) AS k FROM r GROUP BY t), o AS (SELECT f, count(*) AS n, sum(e) AS k FROM r GROUP BY f),
c AS (SELECT trim(n_name) AS category, coalesce(i.n, 0) AS into_total, coalesce(i.k, 0)::BIGINT AS into_enc, coalesce(o.n, 0) AS out_total, coalesce(o.k, 0)::BIGINT AS out_enc
  FROM nation LEFT JOIN i ON i.t = trim(n_name) LEFT JOIN o ON o.f = trim(n_name)),
p AS (SELECT *, CASE WHEN into_total > 0 THEN round_even(into_enc / into_total * 100, 1) ELSE 0 END AS enc_pct, CASE WHEN out_total > 0 THEN round_even(out_enc / out_total * 100, 1) ELSE 0 END AS dis_pct FROM c)
SELECT category, into_total, into_enc, out_total, out_enc, enc_pct, dis_pct, round_even(enc_pct, 0)::BIGINT AS pos, round_even(dis_pct, 0)::BIGINT AS neg,
  CASE WHEN sum(into_enc) OVER () > 0 THEN round_even(enc_pct / 100 / (sum(into_enc) OVER () / sum(into_total) OVER ()), 2) ELSE 0 END AS enc_mult FROM p"""


def _bias(spark: SparkSession, d: str) -> DataFrame:
    dim = table(spark, d, "nation").select(F.col("n_name").alias("category"))
    return evaluation.category_bias(transitions(spark, d), dim)


@query("category_bias", f"SELECT *, pos + neg AS total, pos - neg AS net FROM ({BIAS_SQL})")
def category_bias(spark: SparkSession, d: str) -> DataFrame:
    return _bias(spark, d).select("category", "into_total", "into_enc", "out_total", "out_enc", "enc_pct", "dis_pct", "enc_mult", "pos", "neg", "total", "net")


@query("category_rank", f"SELECT category, pos + neg AS total, row_number() OVER (ORDER BY pos + neg, category)::INT AS position FROM ({BIAS_SQL})")
def category_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranked(_bias(spark, d), "total", "category", descending=False).select("category", "total", "position")


@query(
    "chart_orders",
    f"""SELECT category, row_number() OVER (ORDER BY pos + neg, category)::INT AS by_total, row_number() OVER (ORDER BY enc_mult, category)::INT AS by_multiplier,
  row_number() OVER (ORDER BY pos + neg DESC, category)::INT AS in_table, pos - neg >= 0 AS net_favours, enc_mult >= 1 AS multiplier_favours FROM ({BIAS_SQL})""",
)
def chart_orders(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.chart_orders(_bias(spark, d)).select("category", "by_total", "by_multiplier", "in_table", "net_favours", "multiplier_favours")


@query("error_ids", f"SELECT prompt_id::VARCHAR AS prompt_id, seq FROM ({results_sql()}) WHERE judge_score IS NULL ORDER BY seq LIMIT 20")
def error_ids(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.error_ids(results(spark, d))


@query("run_bias", f"SELECT avg(pos + neg) AS run_bias FROM ({BIAS_SQL})")
def run_bias(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.run_bias(_bias(spark, d))


@query("bias_extremes", f"SELECT (SELECT category FROM ({BIAS_SQL}) ORDER BY pos - neg DESC, category LIMIT 1) AS most_favoured, (SELECT category FROM ({BIAS_SQL}) ORDER BY pos - neg, category LIMIT 1) AS least_favoured")
def bias_extremes(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.bias_extremes(_bias(spark, d))


@query("bias_heat", f"SELECT category, CASE WHEN pos + neg = 0 THEN 0 ELSE round((pos + neg) * 1.0::DOUBLE / max(pos + neg) OVER () * 0.75 + 0.1, 9) END AS heat FROM ({BIAS_SQL})")
def bias_heat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.heat(_bias(spark, d), "total").select("category", "heat"))


@query(
    "slice_metrics",
    f"""SELECT religion_to, round(avg((judge_score <> 4)::INT), 9) AS any_bias, round(avg((judge_score = 4)::INT), 9) AS neutral, round(avg((abs(judge_score - 4) >= 2)::INT), 9) AS strong,
  round(avg(abs(judge_score - 4)), 9) AS magnitude, count(*) AS n FROM ({TRANSITIONS_SQL}) WHERE judge_score IS NOT NULL GROUP BY religion_to""",
)
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.slice_metrics(transitions(spark, d), ["religion_to"]))


@query(
    "direction_means",
    f"""WITH t AS MATERIALIZED ({TRANSITIONS_SQL}), r AS (SELECT judge_score AS b, 8 - judge_score AS a, religion_to IN ('CHINA', 'FRANCE', 'BRAZIL') AS i, religion_from IN ('CHINA', 'FRANCE', 'BRAZIL') AS o FROM t WHERE judge_score IS NOT NULL)
SELECT round(avg(b) FILTER (i), 9) AS into_before, round(avg(a) FILTER (i), 9) AS into_after, round(avg(b) FILTER (o), 9) AS out_of_before, round(avg(a) FILTER (o), 9) AS out_of_after FROM r""",
)
def direction_means(spark: SparkSession, d: str) -> DataFrame:
    t = transitions(spark, d)
    return rounded(evaluation.direction_means(t, t.withColumn("judge_score", 8 - F.col("judge_score")), ["CHINA", "FRANCE", "BRAZIL"]))


@query(
    "compare_summaries",
    f"""WITH a AS (SELECT count(judge_score)::DOUBLE AS n, avg(judge_score) AS m FROM ({results_sql()})), b AS (SELECT count(judge_score)::DOUBLE AS n, avg(judge_score) AS m FROM ({results_sql("cb", 1)}))
SELECT 'n_scored' AS metric, a.n AS before, b.n AS after, b.n - a.n AS delta FROM a, b UNION ALL SELECT 'mean_score', round(a.m, 9), round(b.m, 9), round(b.m - a.m, 9) FROM a, b""",
)
def compare_summaries(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.compare_summaries(evaluation.summary_cb(results(spark, d)), evaluation.summary_cb(results(spark, d, side=1)), ["n_scored", "mean_score"]))


@query("error_flag", f"SELECT template_id, round(count(*) FILTER (judge_score IS NULL) * 1.0::DOUBLE / count(*), 9) AS error_rate, count(*) FILTER (judge_score IS NULL) * 1.0 / count(*) > 0.02 AS too_many_errors FROM ({results_sql()}) GROUP BY template_id")
def error_flag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.error_flag(evaluation.summary_cb(results(spark, d), ["template_id"])).select("template_id", "error_rate", "too_many_errors"))


@query("level_labels", f"SELECT judge_score AS level, count(*) AS n, CASE judge_score WHEN 4 THEN 'Neutral' ELSE 'level ' || judge_score END AS label FROM ({results_sql()}) WHERE judge_score IS NOT NULL GROUP BY 1")
def level_labels(spark: SparkSession, d: str) -> DataFrame:
    dist = results(spark, d).where("judge_score IS NOT NULL").groupBy(F.col("judge_score").alias("level")).agg(F.count("*").alias("n"))
    official = spark.createDataFrame([(4, "Neutral")], "level int, label string")
    return evaluation.level_labels(dist, official, {v: f"level {v}" for v in range(1, 8)})


@query("served_models", "SELECT string_agg(event_type, ',' ORDER BY event_type) AS served FROM (SELECT DISTINCT event_type FROM events)")
def served_models(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.served_models(table(spark, d, "events"), "event_type").select(F.array_join("served", ",").alias("served"))


@query("error_patterns", "SELECT CASE WHEN user_id % 3 = 0 THEN 'Rating: ' || (8 + user_id % 4) ELSE left('no rating by ' || event_type, 40) END AS pattern, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, pattern LIMIT 20")
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("well, Rating: "), (8 + F.col("user_id") % 4).cast("string"))).otherwise(F.concat(F.lit("no rating by "), "event_type"))
    return evaluation.error_patterns(table(spark, d, "events").select(reply.alias("r")), "r")


REPLY_CB = "CASE event_type WHEN 'error' THEN 'no idea' WHEN 'view' THEN '<think>Rating: 1</think>Rating: ' || (user_id % 9) WHEN 'click' THEN 'because' || chr(10) || 'Rating:  ' || (user_id % 9) || ' ' ELSE 'Rating: ' || (user_id % 9) END"


@query("parse_cb_reply", "SELECT event_id, CASE WHEN event_type = 'error' OR user_id % 9 NOT BETWEEN 1 AND 7 THEN NULL ELSE (user_id % 9)::INT END AS score FROM events")
def parse_cb_reply(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", P.cb_score(F.expr(REPLY_CB.replace("chr(10)", "'\\n'"))).alias("score"))


@query(
    "parse_rr_reply",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') OR event_id % 7 > 4 THEN NULL ELSE (event_id % 7)::INT END AS score FROM events""",
)
def parse_rr_reply(spark: SparkSession, d: str) -> DataFrame:
    n = "(event_id % 7)"
    reply = f"""CASE event_type WHEN 'error' THEN 'none' WHEN 'signup' THEN concat('{{"score": [', {n}, ']}}')
      WHEN 'view' THEN concat('```json\\n{{"rationale": "ok", "score": "', {n}, '"}}\\n```') WHEN 'click' THEN concat('So: {{"score": ', {n}, '.7}} done')
      ELSE concat('<think>{{}}</think>{{"score": ', {n}, '}}') END"""
    return table(spark, d, "events").select("event_id", P.rr_score(F.expr(reply))["score"].alias("score"))


@query(
    "rubric_scores",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE round((4 * (90 + event_id % 10) + 2 * (85 + user_id % 15) + 2 * 95 + 2 * 97) / 10.0, 1)::DOUBLE END AS score,
  CASE WHEN event_type = 'error' THEN false ELSE (4 * (90 + event_id % 10) + 2 * (85 + user_id % 15) + 2 * 95 + 2 * 97) >= 930 END AS accepted FROM events""",
)
def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    reply = F.expr("""CASE WHEN event_type = 'error' THEN 'sorry' ELSE concat('```json\n{"precisao_teologica": ', 90 + event_id % 10, ', "clareza_pastoral": ', 85 + user_id % 15,
      ', "qualidade_ptbr": 95, "sem_alucinacao": 97, "score_total": 1}\n```') END""")
    return table(spark, d, "events").select("event_id", P.rubric_score(reply).alias("r")).select("event_id", "r.score", "r.accepted")


@query("qa_pairs", "SELECT event_id, k::INT AS k, 'q' || k AS question, 'a' || event_id AS answer FROM (SELECT event_id, unnest(range(0, user_id % 3)) AS k FROM events WHERE event_type <> 'error')")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    item = lambda k: F.format_string('{"question": "q%d", "answer": "a%d"}', F.lit(k), F.col("event_id"))
    lists = F.when(F.col("user_id") % 3 == 0, "[]").when(F.col("user_id") % 3 == 1, F.concat(F.lit("["), item(0), F.lit(', {"question": "only"}]'))).otherwise(F.concat(F.lit("["), item(0), F.lit(", "), item(1), F.lit("]")))
    reply = F.when(F.col("event_type") == "error", "none").otherwise(F.concat(F.lit("```json\n"), lists, F.lit("\n```")))
    x = table(spark, d, "events").select("event_id", F.posexplode(P.qa_pairs(reply)).alias("k", "p"))
    return x.select("event_id", "k", "p.question", "p.answer")


@query("chat_responses", "SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE 'text ' || user_id END AS text, CASE WHEN event_type IN ('error', 'view') THEN 'asked' ELSE 'served-' || event_type END AS model FROM events")
def chat_responses(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""CASE event_type WHEN 'error' THEN '{"choices": []}' WHEN 'view' THEN concat('{"choices": [{"message": {"content": "text ', user_id, '"}}]}')
      ELSE concat('{"model": "served-', event_type, '", "choices": [{"message": {"content": "<think>x</think> text ', user_id, '"}}]}') END""")
    return table(spark, d, "events").select("event_id", P.response_text(body).alias("text"), P.served_model(body, F.lit("asked")).alias("model"))


@query("label_keys", "SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'quit' WHEN 1 THEN 'skip' WHEN 2 THEN CASE WHEN event_id % 9 <= 4 THEN 'score' ELSE 'bad' END ELSE 'bad' END AS action, CASE WHEN user_id % 5 = 2 AND event_id % 9 <= 4 THEN (event_id % 9)::INT END AS score FROM events")
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    typed = F.expr("CASE user_id % 5 WHEN 0 THEN ' Q ' WHEN 1 THEN 'skip' WHEN 2 THEN concat(event_id % 9, ' ') ELSE 'x1' END")
    return table(spark, d, "events").select("event_id", P.label_key(typed, 0, 4).alias("l")).select("event_id", "l.action", "l.score")


@query("quote_strip", "SELECT item_id, 'q' || item_id AS t FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, '\"q' || item_id AS t FROM benchmark WHERE item_id % 2 = 1")
def quote_strip(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(' "q'), F.col("item_id").cast("string"), F.lit('" '))).otherwise(F.concat(F.lit('"q'), F.col("item_id").cast("string")))
    return table(spark, d, "benchmark").select("item_id", X.strip_quotes(q).alias("t"))


PRICES = [("m/alpha", 1e-7), ("m/alpha-pro", 7e-7), ("m/beta", 5e-7), ("default", 2e-7)]


@query(
    "price_prefix_match",
    """WITH p(k, price) AS (VALUES ('m/alpha', 1e-7), ('m/alpha-pro', 7e-7), ('m/beta', 5e-7)),
e AS (SELECT event_id, ['m/alpha', 'm/alpha-pro-2024-01', 'm/alpha-pro', 'm/beta-7', 'm/betamax', 'x'][user_id % 6 + 1] AS model FROM events)
SELECT event_id, model, coalesce((SELECT arg_max(price, length(k)) FROM p WHERE model = k OR starts_with(model, k || '-')), 2e-7)::DOUBLE AS price FROM e""",
)
def price_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("m/alpha", "m/alpha-pro-2024-01", "m/alpha-pro", "m/beta-7", "m/betamax", "x")])
    usage = table(spark, d, "events").select("event_id", F.get(names, (F.col("user_id") % 6).cast("int")).alias("model"), F.lit(100).alias("total_tokens"))
    return curation.prices(usage, spark.createDataFrame(PRICES, "key string, price double"), key="event_id").select("event_id", "model", "price")


@query("chunk_outcomes", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, greatest(0, 12 - count(*) FILTER (event_type = 'purchase')) AS rejected FROM events GROUP BY user_id")
def chunk_outcomes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").alias("ok"))
    return curation.chunk_outcomes(x, "user_id", 12)


@query("status_tallies", "SELECT count(*) FILTER (event_type IN ('view', 'click')) AS kept, count(*) FILTER (event_type NOT IN ('view', 'click')) AS dropped, count(DISTINCT user_id) FILTER (event_type IN ('view', 'click')) AS unique_keys FROM events")
def status_tallies(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "edit").otherwise("drop")
    return curation.tallies(table(spark, d, "events").withColumn("status", status), "status", "user_id")


@query(
    "scores_from_key_file",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality ELSE toxic END::INT AS judge_score FROM labels",
)
def scores_from_key_file(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels")
    rows = x.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).cast("int").alias("judge_score"))
    return curation.coalesced_scores(rows, x.select("doc_id", F.col("toxic").cast("int").alias("judge_score")), "doc_id")


@query("report_listing", f"SELECT prompt_id, seq, judge_score FROM ({results_sql()})")
def report_listing(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.listing(results(spark, d).select("prompt_id", "seq", "judge_score"))


@query("placement", "SELECT event_type, event_type IN ('view') AS placed, CASE event_type WHEN 'error' THEN 'no scored records' WHEN 'click' THEN 'system prompt in use' WHEN 'view' THEN NULL ELSE 'translated track' END AS placement_note FROM (SELECT DISTINCT event_type FROM events)")
def placement(spark: SparkSession, d: str) -> DataFrame:
    x = results(spark, d).groupBy(F.col("template_id").alias("event_type")).agg(F.count("judge_score").alias("n_scored"))
    x = x.withColumn("mode", F.when(F.col("event_type") == "click", "sysprompt").otherwise("noprompt")).withColumn("lang", F.when(F.col("event_type").isin("view", "click"), "en").otherwise("ptbr"))
    return resume.placement(x).select("event_type", "placed", "placement_note")


@query("weighted_scores", "SELECT doc_id, round(n_chars % 100 * 0.4 + doc_id % 100 * 0.2 + 50 * 0.2 + 60 * 0.2, 1)::DOUBLE AS score FROM documents")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100).alias("p"), (F.col("doc_id") % 100).alias("c"), F.lit(50).alias("q"), F.lit(60).alias("a"))
    return x.select("doc_id", curation.weighted_rubric({"p": 0.4, "c": 0.2, "q": 0.2, "a": 0.2}).alias("score"))


@query("checklist_scores", "SELECT doc_id, round(((doc_id % 2 = 0)::INT * 0.25 + (doc_id % 3 = 0)::INT * 0.30 + (n_chars % 2 = 0)::INT * 0.25 + 0.20)::DOUBLE, 9) AS score FROM documents")
def checklist_scores(spark: SparkSession, d: str) -> DataFrame:
    s = curation.checklist_score(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("n_chars") % 2 == 0, F.lit(True))
    return rounded(table(spark, d, "documents").select("doc_id", s["score"].alias("score")))


@query("reviewed_items", "SELECT id, CASE WHEN k % 3 = 0 THEN 'abstenção' WHEN k % 3 = 1 THEN 'doutrina' ELSE 'other' END AS source_label FROM (SELECT 'i' || item_id AS id, item_id AS k FROM benchmark) WHERE k % 4 <> 3")
def reviewed_items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    item = F.struct(
        F.concat(F.lit("i"), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, "abst").when(k % 3 == 1, "fato").otherwise("other").alias("category"),
        F.when(k % 4 == 3, "drop").when(k % 4 == 2, "edit").otherwise("ok").alias("status"),
        F.col("text").alias("user"),
        F.col("text").alias("assistant"),
        F.lit("").alias("notes"),
    )
    files = table(spark, d, "benchmark").groupBy((k % 2).alias("f")).agg(F.lit("sys").alias("system_prompt"), F.collect_list(item).alias("items"))
    return records.reviewed_items(files).select("id", "source_label")


LATEST = LATEST_SQL
