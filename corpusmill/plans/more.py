"""Queries of the other parsers, report functions, caps and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import curation, dedup, evaluation, parsers, resume, stats
from corpusmill.plans.evaluation import rounded
from corpusmill.plans.statistics import PAIRS_SQL, pairs
from corpusmill.plans.tables import query, results, results_sql, table

# The parsers' documents are made of benchmark items, letters only, one document an item: most are well formed, some are too
# short, lack a part or come in another shape, and all have text before and after what the rule looks for.
BODY_SQL = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))"


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    x = table(spark, d, "benchmark").withColumn("body", F.regexp_replace("text", "[^A-Za-z ]", " "))
    return x, F.col("item_id").cast("string"), F.col("item_id") % 5


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _parsed(docs: DataFrame, name: str, text: Column) -> DataFrame:
    x = parsers.parse_all(docs.select(F.lit(name).alias("doc"), text.alias("text")), [name])
    return x.select("source", "question", "answer", F.get("confessional_refs", F.lit(0)).alias("ref"))


@query(
    "parse_wlc",
    f"""SELECT 'WLC_' || item_id AS source, 'What is item ' || item_id || '?' AS question, {BODY_SQL} AS answer, 'WLC ' || item_id AS ref FROM benchmark
WHERE item_id % 5 NOT IN (1, 2) AND length({BODY_SQL}) >= 10""",
)
def parse_wlc(spark: SparkSession, d: str) -> DataFrame:
    """An answer of under ten characters, and a question without one, are no record."""
    x, n, case = _items(spark, d)
    answer = F.when(case == 1, "Too few").otherwise(F.col("body"))
    gap = F.when(case == 2, "\n").otherwise("\n\n\n")
    return _parsed(x, "wlc", _text("Preface 7. none\n", n, ". What is\r\n   item ", n, "?", gap, answer, F.when(case == 3, "\n\nA note that is left out").otherwise("")))


@query(
    "parse_heidelberg",
    f"""SELECT 'Heidelberg_' || item_id AS source, 'What of ' || item_id || '?' AS question, {BODY_SQL} || CASE WHEN item_id % 5 = 4 THEN ' More of it' ELSE '' END AS answer, 'HC ' || item_id AS ref
FROM benchmark WHERE item_id % 5 <> 2 AND length({BODY_SQL}) > 0""",
)
def parse_heidelberg(spark: SparkSession, d: str) -> DataFrame:
    """An answer runs over blank lines, up to a Lord's Day, a part or the end."""
    x, n, case = _items(spark, d)
    tail = F.when(case == 4, "\n\nMore of it").when(case == 3, "\n\nDIA DO SENHOR 9\nleft out").when(case == 1, "\n\nParte II").otherwise("")
    return _parsed(x, "heidelberg", _text("DIA DO SENHOR 1\n\n", n, ". What of ", n, "?", F.when(case == 2, " ").otherwise("\n\n"), F.col("body"), tail))


_WHOLE = "O que ensina a Confissão de Fé de Westminster no Capítulo ' || item_id || ' (Of item ' || item_id || ')"


@query(
    "parse_wcf",
    f"""WITH b AS (SELECT item_id, {BODY_SQL} AS body FROM benchmark)
SELECT 'WCF_' || item_id || '.' || k AS source, '{_WHOLE}, artigo ' || k || '?' AS question, body || CASE k WHEN 2 THEN ' again' ELSE '' END AS answer, 'WCF ' || item_id || '.' || k AS ref
FROM b, (SELECT unnest([1, 2]) AS k) WHERE item_id % 5 NOT IN (1, 2) AND length(body || CASE k WHEN 2 THEN ' again' ELSE '' END) >= 40
UNION ALL SELECT 'WCF_' || item_id, '{_WHOLE}?', body, 'WCF ' || item_id FROM b WHERE item_id % 5 = 1 AND length(body) >= 50""",
)
def parse_wcf(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of articles; one without is an answer as a whole; one without a title is none; articles under 40 characters go."""
    x, n, case = _items(spark, d)
    head = F.when(case == 3, _text("Capítulo ", n, ": Of item ", n, "  \n")).when(case == 2, _text("CAPITULO ", n)).otherwise(_text("CAPÍTULO ", n, "  Of item ", n, "\n"))
    articles = F.when(case == 1, F.col("body")).otherwise(_text("1. ", F.col("body"), "\n2. ", F.col("body"), " again\n3. Too short."))
    return _parsed(x, "wcf", _text("Of old\n1. ", "x" * 50, "\n", head, articles))


@query(
    "parse_lcf",
    f"""WITH b AS (SELECT item_id, {BODY_SQL} AS body FROM benchmark)
SELECT 'LCF_' || item_id || '.7' AS source, 'O que ensina a Confissão Batista de Londres de 1689 no Capítulo ' || item_id || ' (Of item ' || item_id || '), parágrafo 7?' AS question, body AS answer, 'LCF ' || item_id || '.7' AS ref
FROM b WHERE item_id % 5 NOT IN (1, 2) AND length(body) >= 40
UNION ALL SELECT 'LCF_' || item_id, 'O que ensina a Confissão Batista de Londres de 1689 no Capítulo ' || item_id || ' (Of item ' || item_id || ')?', body, 'LCF ' || item_id FROM b WHERE item_id % 5 = 1 AND length(body) >= 50""",
)
def parse_lcf(spark: SparkSession, d: str) -> DataFrame:
    """The title is on a line of its own; a chapter with it beside the number is none."""
    x, n, case = _items(spark, d)
    head = F.when(case == 2, _text("CAPÍTULO ", n, " Of item ", n, "\n")).otherwise(_text("CAPÍTULO ", n, "\n\nOf item ", n, "\n"))
    return _parsed(x, "lcf", _text("Before\n", head, F.when(case == 1, F.col("body")).otherwise(_text("7. ", F.col("body"), "\n8. Short"))))


@query(
    "parse_dort",
    f"""WITH b AS (SELECT item_id, {BODY_SQL} AS body FROM benchmark)
SELECT 'Dort_' || item_id || '.1' AS source, 'O que ensinam os Cânones de Dort sobre ''Of item ' || item_id || ''' (Capítulo ' || item_id || ', Artigo 1)?' AS question, body AS answer, 'Dort ' || item_id || '.1' AS ref FROM b WHERE item_id % 5 <> 1 AND length(body) >= 40
UNION ALL SELECT 'Dort_' || item_id || '.rej2', 'O que os Cânones de Dort rejeitam como erro no Capítulo ' || item_id || ' (Of item ' || item_id || '), Rejeição 2?', body || ' denied', 'Dort ' || item_id || ' rejeição 2' FROM b WHERE item_id % 5 NOT IN (1, 2) AND length(body || ' denied') >= 40""",
)
def parse_dort(spark: SparkSession, d: str) -> DataFrame:
    """Articles end where rejections begin; a chapter without a title is none; a short article goes."""
    x, n, case = _items(spark, d)
    head = F.when(case == 1, _text("Capítulo ", n, " ")).otherwise(_text("Capítulo ", n, "\nOf item ", n, "\n"))
    denied = F.when(case == 2, "").otherwise(_text("\nREJEIÇÃO 2\n", F.col("body"), " denied"))
    return _parsed(x, "dort", _text("Preface\n", head, "ARTIGO 1\n", F.col("body"), "\nARTIGO 2\nShort.", denied))


@query("slugs", "SELECT doc_id, replace(replace(source || '/a-b', '/', '_'), '-', '_') AS model_slug, left(regexp_replace(left(text, 60), '[\\s\\x0b\\x1c-\\x1f\\x85]+', '_', 'g'), 20) AS source_slug, left(text, 80) AS preview FROM documents")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", X.slug(F.concat("source", F.lit("/a-b"))).alias("model_slug"), X.source_slug(F.left("text", F.lit(60)), 20).alias("source_slug"), X.preview("text", 80).alias("preview"))


@query("number_formats", "SELECT event_id, CASE WHEN event_type = 'error' THEN '—' ELSE format('{:.1f}%', (event_id % 1001) / 10.0) END AS share, CASE WHEN event_type = 'error' THEN '—' ELSE user_id::VARCHAR END AS number FROM events")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    known = lambda c: F.when(F.col("event_type") != "error", c)
    return table(spark, d, "events").select("event_id", X.percent(known((F.col("event_id") % 1001) / 1000)).alias("share"), X.number_or_dash(known(F.col("user_id"))).alias("number"))


@query(
    "bands",
    """WITH x AS (SELECT event_id, (event_id % 41) / 10.0 AS m, (event_id % 61 - 30) / 10.0 AS d, (event_id % 100) / 1000.0 AS p FROM events)
SELECT event_id, CASE WHEN m < 0.5 THEN 'very low' WHEN m < 1.5 THEN 'low' WHEN m < 2.5 THEN 'moderate' ELSE 'high' END AS rr,
  CASE WHEN abs(d) < 0.1 THEN 'neutral' WHEN abs(d) < 0.5 THEN 'slight' ELSE 'marked' END || CASE WHEN d < 0 THEN ' encouraging' WHEN d > 0 THEN ' discouraging' ELSE ' neutral' END AS cb,
  CASE WHEN p < 0.05 THEN 'p<0.05' ELSE 'n.s.' END || CASE WHEN d > 0 THEN ' ▲' WHEN d < 0 THEN ' ▼' ELSE ' —' END AS significance FROM x""",
)
def bands(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    x = table(spark, d, "events").select(n, (n % 41 / 10).alias("m"), ((n % 61 - 30) / 10).alias("d"), (n % 100 / 1000).alias("p"))
    return x.select("event_id", evaluation.rr_band(F.col("m")).alias("rr"), evaluation.cb_band(F.col("d")).alias("cb"), evaluation.significance(F.col("p"), F.col("d")).alias("significance"))


@query("primary_metric", f"SELECT 'cb' AS benchmark, 'mean_score' AS metric, round(avg(judge_score), 9) AS value, true AS leaderboard_comparable FROM ({results_sql()})")
def primary_metric(spark: SparkSession, d: str) -> DataFrame:
    x = evaluation.primary_metric(evaluation.summary_cb(results(spark, d)), "cb", "en", "noprompt")
    return rounded(x.select("benchmark", "metric", "value", "leaderboard_comparable"))


@query(
    "primary_interval",
    f"""SELECT 'cb' AS benchmark, round(avg(judge_score) - 1.959963984540054 * stddev_samp(judge_score) / sqrt(count(judge_score)), 9) AS low,
  round(avg(judge_score) + 1.959963984540054 * stddev_samp(judge_score) / sqrt(count(judge_score)), 9) AS high, false AS leaderboard_comparable FROM ({results_sql()})""",
)
def primary_interval(spark: SparkSession, d: str) -> DataFrame:
    """The headline number's interval, of a translated run: it is not for the public board."""
    x = evaluation.primary_metric(evaluation.summary_cb(results(spark, d)), "cb", "pt-BR", "noprompt")
    return rounded(x.select("benchmark", "low", "high", "leaderboard_comparable"))


@query("legacy_guard", f"SELECT count(*) AS n, count(judge_score) AS n_scored FROM ({results_sql()})")
def legacy_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either schema, none of them old: all pass."""
    new = F.col("seq") % 2 == 0
    x = results(spark, d).withColumns({"judge_rationale": F.lit("why"), "judge_reasoning": F.when(new, "both")})
    return resume.reject_legacy(x).agg(F.count("*").alias("n"), F.count("judge_score").alias("n_scored"))


@query(
    "comparability",
    """WITH s AS (SELECT list_sort(list(DISTINCT event_type)) AS served FROM events),
o AS (SELECT 'same' AS what, served AS other, 'j' AS judge FROM s UNION ALL SELECT 'other snapshot', ['x'], 'j' UNION ALL SELECT 'other judge', served, 'k' FROM s)
SELECT what, CASE WHEN judge <> 'j' THEN 'incomparable' WHEN other IS DISTINCT FROM served THEN 'snapshot drift' ELSE 'comparable' END AS status FROM o, s""",
)
def comparability(spark: SparkSession, d: str) -> DataFrame:
    one = evaluation.served_models(table(spark, d, "events"), "event_type").select(F.lit("j").alias("judge_model"), F.lit(1024).alias("judge_max_tokens"), "served")
    others = {"same": one, "other snapshot": one.withColumn("served", F.array(F.lit("x"))), "other judge": one.withColumn("judge_model", F.lit("k"))}
    parts = [resume.comparability(one, o).select(F.lit(what).alias("what"), "status") for what, o in others.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "lines_first_wins",
    """WITH l AS (SELECT event_id AS pos, CASE WHEN event_id % 10 = 0 THEN left(props, 4) ELSE props END AS line, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events)
SELECT pos, line FROM l WHERE k IS NULL UNION ALL SELECT min(pos), arg_min(line, pos) FROM l WHERE k IS NOT NULL GROUP BY k""",
)
def lines_first_wins(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    x = table(spark, d, "events").select(F.col("event_id").alias("pos"), line.alias("line"))
    return dedup.lines_first_wins(x, "line", "pos", F.get_json_object("line", "$.k")).select("pos", "line")


CHUNKS_SQL = "SELECT source, doc_id FROM documents"


@query("first_sources", f"WITH s AS (SELECT source, min(doc_id) AS f FROM ({CHUNKS_SQL}) GROUP BY source ORDER BY f LIMIT 7) SELECT source, doc_id FROM ({CHUNKS_SQL}) WHERE source IN (SELECT source FROM s)")
def first_sources(spark: SparkSession, d: str) -> DataFrame:
    return curation.first_sources(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 7)


@query("cheapest_offers", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS price FROM events ORDER BY coalesce(price, 999), event_id LIMIT 10")
def cheapest_offers(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("price"))
    return curation.cheapest(x, "price", "event_id")


@query("direction_disagreement", f"SELECT count(*) AS n, count(*) FILTER (abs(before - after) >= 2) AS n_off_by_two, count(*) FILTER (sign(before - 4) <> sign(after - 4)) AS n_direction FROM ({PAIRS_SQL})")
def direction_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return stats.direction_disagreement(pairs(spark, d), "before", "after", 4)
