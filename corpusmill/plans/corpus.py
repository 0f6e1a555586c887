"""Queries of the curation side: records, chunks, dedup, profiles, splits, filters, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.functions import text as X
from corpusmill.operators import chunking, curation, dedup, eda, records, resume, sampling, semantic
from corpusmill.operators.parsers import parse_all
from corpusmill.plans.tables import query, table

THREADS = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id"
PY_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x85]+|[\s\x0b\x1c-\x1f\x85]+$', '', 'g')"
Q = "replace(to_json({0}), 'x', 'x')"


def threads(spark: SparkSession, d: str) -> DataFrame:
    return records.threads(table(spark, d, "conversations"))


@query("conv_messages", f"SELECT conv_id, len(m) AS n_messages, list_aggregate(list_transform(m, lambda x: x.role), 'string_agg', ',') AS roles FROM ({THREADS})")
def conv_messages(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query(
    "conv_first_last",
    f"""SELECT conv_id, coalesce(list_filter(m, lambda x: x.role = 'user')[1].content, '') AS first_user,
  coalesce(list_filter(m, lambda x: x.role = 'assistant')[-1].content, '') AS last_assistant,
  coalesce(list_aggregate(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: x.content), 'string_agg', ' '), '') AS spoken FROM ({THREADS})""",
)
def conv_first_last(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).select("conv_id", H.first_user("messages").alias("first_user"), H.last_assistant("messages").alias("last_assistant"), H.spoken_text("messages").alias("spoken"))


HASHED = f"""SELECT conv_id, m, sha256('{{"lang": "pt-BR", "messages": [' || list_aggregate(list_transform(m, lambda x:
  '{{"content": ' || to_json(x.content) || ', "role": ' || to_json(x.role) || '}}'), 'string_agg', ', ') || '], "tradition": "general"}}') AS sha256 FROM ({THREADS})"""


@query("conv_content_hash", f"SELECT conv_id, sha256 FROM ({HASHED})")
def conv_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).select("conv_id", H.content_hash("messages", F.lit("general"), F.lit("pt-BR")).alias("sha256"))


@query("conv_records", f"SELECT 'rec-b-' || left(sha256, 12) AS id, conv_id, len(m) AS n_messages FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY conv_id) AS r FROM ({HASHED})) WHERE r = 1")
def conv_records(spark: SparkSession, d: str) -> DataFrame:
    x = threads(spark, d).withColumn("sha256", H.content_hash("messages", F.lit("general"), F.lit("pt-BR")))
    x = dedup.first_wins(x, F.col("sha256"), ["conv_id"])
    return x.select(F.concat(F.lit("rec-b-"), F.left("sha256", F.lit(12))).alias("id"), "conv_id", F.size("messages").cast("long").alias("n_messages"))


@query("doc_sequence_ids", "SELECT doc_id, 'rec-' || printf('%05d', row_number() OVER (ORDER BY source, doc_id)) AS id FROM documents")
def doc_sequence_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.with_sequence_ids(table(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], "rec").select("doc_id", "id")


@query("doc_dedup_first", "SELECT doc_id, sha256(text) AS sha FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def doc_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return dedup.first_wins(x, F.col("sha"), ["doc_id"])


@query(
    "doc_dedup_keep_empty",
    """SELECT doc_id, sha FROM (SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN '' ELSE sha256(text) END AS sha FROM documents)
QUALIFY sha = '' OR row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1""",
)
def doc_dedup_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.when(F.length("text") % 5 == 0, "").otherwise(F.sha2("text", 256)).alias("sha"))
    return dedup.first_wins(x, F.col("sha"), ["doc_id"], keep_empty=True)


@query("doc_dup_report", "SELECT count(*) AS duplicate_keys, coalesce(sum(n), 0)::BIGINT AS rows_affected FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text) HAVING count(*) > 1)")
def doc_dup_report(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_report(table(spark, d, "documents").select(F.sha2("text", 256).alias("sha")), "sha")


CHUNKS = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_idx, chunk FROM (
  SELECT doc_id, s, {strip} AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 3500)) AS s FROM documents)
  WHERE s = 0 OR s + 500 < length(text)) WHERE length(chunk) > 200""".format(strip=PY_STRIP.format("substr(text, s + 1, 4000)"))
HASH_SQL = "left(sha256(doc_id || '::' || chunk_idx || '::' || length(chunk) || '::' || left(chunk, 200)), 16)"


@query("doc_chunks", f"SELECT doc_id, chunk_idx::INT AS chunk_idx, chunk FROM ({CHUNKS})")
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_idx", "chunk")


@query("chunk_hash", f"SELECT doc_id, chunk_idx::INT AS chunk_idx, {HASH_SQL} AS chunk_hash FROM ({CHUNKS})")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_idx", "chunk_hash")


@query(
    "doc_chunks_sampled",
    f"""SELECT doc_id, count(*) AS n_chunks, min(chunk_idx) AS first_idx, max(chunk_idx) AS last_idx, sum(chunk_idx)::BIGINT AS sum_idx FROM ({CHUNKS}) c
JOIN (SELECT doc_id, n, unnest(CASE WHEN n > 3 THEN list_distinct(list_transform(range(0, 3), lambda i: round_even(i * (n - 1) / 2.0, 0)::BIGINT)) ELSE range(0, n) END) AS k
  FROM (SELECT doc_id, count(*) AS n FROM ({CHUNKS}) GROUP BY doc_id)) s USING (doc_id) WHERE chunk_idx = k GROUP BY doc_id""",
)
def doc_chunks_sampled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    w = chunking.windows(F.col("text"))
    numbered = F.transform(w, lambda c, i: i)
    x = docs.select("doc_id", F.explode(chunking.evenly(numbered, 3)).alias("chunk_idx"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_idx").cast("long").alias("first_idx"), F.max("chunk_idx").cast("long").alias("last_idx"), F.sum("chunk_idx").alias("sum_idx"))


@query(
    "chunk_resume",
    f"""WITH c AS (SELECT *, {HASH_SQL} AS h FROM ({CHUNKS})) SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0 OR doc_id % 5 = 0) AS done,
  count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS remaining FROM c""",
)
def chunk_resume(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunks(table(spark, d, "documents"), "doc_id", "text")
    return resume.progress(c, c.where("doc_id % 3 = 0").unionByName(c.where("doc_id % 5 = 0")))


@query("chunk_remaining", f"SELECT doc_id, {HASH_SQL} AS chunk_hash FROM ({CHUNKS}) WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def chunk_remaining(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunks(table(spark, d, "documents"), "doc_id", "text")
    return resume.remaining_chunks(c, c.where("doc_id % 3 = 0"), c.where("doc_id % 5 = 0")).select("doc_id", "chunk_hash")


@query("chunk_seeded", f"SELECT doc_id, {HASH_SQL} AS chunk_hash FROM ({CHUNKS}) WHERE doc_id IN (SELECT doc_id FROM labels)")
def chunk_seeded(spark: SparkSession, d: str) -> DataFrame:
    return resume.seeded_chunks(chunking.chunks(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "labels"), "doc_id").select("doc_id", "chunk_hash")


WORDS = r"len(regexp_extract_all(text, '[^\s\x0b\x1c-\x1f\x85]+'))"


@query(
    "doc_length_stats",
    f"""WITH w AS (SELECT {WORDS} AS n FROM documents), l AS (SELECT list_sort(list(n)) AS s FROM w)
SELECT count(n) AS n, min(n)::INT AS min, max(n)::INT AS max, avg(n) AS mean, median(n) AS median,
  (SELECT s[(floor(len(s) * 0.9)::INT) + 1] FROM l)::INT AS p90, (SELECT s[(floor(len(s) * 0.99)::INT) + 1] FROM l)::INT AS p99 FROM w""",
)
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return eda.length_stats(table(spark, d, "documents").select(X.word_count("text").alias("w")), "w")


@query(
    "doc_length_by_lang",
    f"""SELECT lang, count(n) AS n, min(n)::INT AS min, max(n)::INT AS max, avg(n) AS mean, median(n) AS median,
  (list_sort(list(n))[(floor(count(*) * 0.9)::INT) + 1])::INT AS p90, (list_sort(list(n))[(floor(count(*) * 0.99)::INT) + 1])::INT AS p99
FROM (SELECT lang, {WORDS} AS n FROM documents) GROUP BY lang""",
)
def doc_length_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return eda.length_stats(table(spark, d, "documents").select("lang", X.word_count("text").alias("w")), "w", ["lang"])


@query(
    "doc_len_histogram",
    f"""WITH b AS (SELECT ({WORDS} // 50) * 50 AS bucket, count(*) AS n FROM documents GROUP BY 1)
SELECT r.bucket, coalesce(b.n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(bucket) FROM b) + 1, 50)) AS bucket) r LEFT JOIN b USING (bucket)""",
)
def doc_len_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(table(spark, d, "documents").select(X.word_count("text").alias("w")), "w")


@query("lang_counts", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
def lang_counts(spark: SparkSession, d: str) -> DataFrame:
    return eda.counts(table(spark, d, "documents"), "lang")


@query("source_family_counts", "SELECT split_part(source || '_' || lang, '_', 1) AS value, count(*) AS n FROM documents GROUP BY 1")
def source_family_counts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.concat_ws("_", "source", "lang").alias("s"))
    return eda.counts(x, eda.family("s"))


@query("topk_sources", "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 5")
def topk_sources(spark: SparkSession, d: str) -> DataFrame:
    return eda.top(table(spark, d, "documents"), F.col("source"), 5, "doc_id")


@query("ref_coverage", "SELECT count(*) AS n, count(*) FILTER (n_chars % 7 <> 0) AS with_refs, count(*) FILTER (n_chars % 7 <> 0) * 100.0 / count(*) AS pct FROM documents")
def ref_coverage(spark: SparkSession, d: str) -> DataFrame:
    refs = F.when(F.col("n_chars") % 7 != 0, F.array(F.concat_ws(" ", "lang", "source"))).otherwise(F.array().cast("array<string>"))
    x = eda.reference_coverage(table(spark, d, "documents").select(refs.alias("refs")), "refs")
    return x.withColumn("pct", F.col("with_refs") * 100.0 / F.col("n"))


@query("ref_prefixes", "SELECT lang AS prefix, count(*) AS n FROM documents WHERE n_chars % 7 <> 0 GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def ref_prefixes(spark: SparkSession, d: str) -> DataFrame:
    refs = F.when(F.col("n_chars") % 7 != 0, F.array(F.concat_ws(" ", "lang", "source")))
    return eda.reference_prefixes(table(spark, d, "documents").select(refs.alias("refs")), "refs")


@query("quality_profile", "SELECT count(v) AS n, avg(v) AS mean, min(v) AS min, list_sort(list(v))[(floor(count(v) * 0.1)::INT) + 1] AS p10 FROM (SELECT 80 + n_chars % 21 AS v FROM documents)")
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return eda.quality_profile(table(spark, d, "documents").select((80 + F.col("n_chars") % 21).alias("v")), "v")


@query("topic_balance", "SELECT t.lang, low, high, coalesce(n, 0) AS actual, CASE WHEN coalesce(n, 0) < low THEN 'below' WHEN coalesce(n, 0) > high THEN 'above' ELSE 'on' END AS status FROM (VALUES ('en', 100, 400), ('fr', 50, 300), ('pt', 1, 9)) t(lang, low, high) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) USING (lang)")
def topic_balance(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("en", 100, 400), ("fr", 50, 300), ("pt", 1, 9)], "lang string, low int, high int")
    return eda.against_targets(eda.counts(table(spark, d, "documents"), "lang", "lang"), targets, "lang", "n")


@query("lang_dominance", "SELECT lang, n, n / sum(n) OVER () AS share, n / sum(n) OVER () > 0.6 AS dominant FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def lang_dominance(spark: SparkSession, d: str) -> DataFrame:
    return eda.dominance(table(spark, d, "documents"), "lang", 0.6)


@query("tier_views", "SELECT coalesce(lang, 'all') AS view, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), ())")
def tier_views(spark: SparkSession, d: str) -> DataFrame:
    return eda.tier_views(table(spark, d, "documents"), "lang", F.sum("n_chars"), "chars")


@query("id_prefix_counts", "SELECT left(source, 4) AS prefix, count(*) AS n FROM documents GROUP BY 1")
def id_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    return eda.prefix_counts(table(spark, d, "documents"), "source", 4)


RANKED = "SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY {g}) AS n FROM documents"


@query("split_assign", f"SELECT doc_id, lang, CASE WHEN r <= greatest(1, round_even(n * 0.05, 0)) THEN 'eval' ELSE 'train' END AS split FROM ({RANKED.format(g='lang')})")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.05)


@query("split_manifest", f"SELECT split, lang AS tier, count(*) AS n_records FROM (SELECT lang, CASE WHEN r <= greatest(1, round_even(n * 0.05, 0)) THEN 'eval' ELSE 'train' END AS split FROM ({RANKED.format(g='lang')})) GROUP BY 1, 2")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_manifest(split_assign(spark, d), "lang")


@query(
    "split_three_way",
    f"SELECT doc_id, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.9, 0) THEN 'eval' ELSE 'test' END AS split FROM ({RANKED.format(g='lang, source')})",
)
def split_three_way(spark: SparkSession, d: str) -> DataFrame:
    return sampling.three_way_split(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id").select("doc_id", "split")


@query("review_sample", f"SELECT doc_id, source FROM ({RANKED.format(g='source')}) WHERE r <= greatest(1, round_even(n * 0.1, 0))")
def review_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fraction_sample(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 0.1)


@query("uniform_sample", "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.uniform_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("toxic_quality_filter", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR coalesce(l.quality, 0) >= 1")
def toxic_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    x = curation.with_sidecar(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "quality", 1)
    return x.select("doc_id", "quality")


@query("quality_bands", "SELECT CASE WHEN v >= 93 THEN 'include' WHEN v >= 80 THEN 'review' ELSE 'discard' END AS band, count(*) AS n FROM (SELECT 70 + n_chars % 31 AS v FROM documents) GROUP BY 1")
def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    return eda.counts(table(spark, d, "documents").select(curation.quality_band(70 + F.col("n_chars") % 31).alias("b")), "b", "band")


@query("length_and_phrases", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 50 AND 2000 AND NOT contains(lower(text), 'the of') AND NOT contains(lower(text), 'de la')")
def length_and_phrases(spark: SparkSession, d: str) -> DataFrame:
    return curation.acceptable_answers(table(spark, d, "documents"), "text", 50, 2000, ["the of", "De la"]).select("doc_id")


@query("length_floors", "SELECT doc_id FROM documents WHERE length(text) >= 500 AND source NOT IN ('src0', 'src3')")
def length_floors(spark: SparkSession, d: str) -> DataFrame:
    return curation.excluded(table(spark, d, "documents").where(F.length("text") >= 500), "source", ["src0", "src3"]).select("doc_id")


@query("blank_prompts", "SELECT item_id FROM benchmark WHERE item_id % 4 <> 0")
def blank_prompts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 0, " \t \n").otherwise(F.col("text")).alias("prompt"))
    return x.where(curation.not_blank("prompt")).select("item_id")


@query("overlong_drop", f"SELECT doc_id, {WORDS}::BIGINT AS n_tokens, {WORDS} <= 400 AS kept FROM documents")
def overlong_drop(spark: SparkSession, d: str) -> DataFrame:
    return records.overlong(table(spark, d, "documents").select("doc_id", "text"), X.word_count("text"), 400).drop("text")


@query("ablation_minus_source", "SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'")
def ablation_minus_source(spark: SparkSession, d: str) -> DataFrame:
    return curation.without_source(table(spark, d, "documents"), "source", "src1").select("doc_id")


@query("translate_join", "SELECT b.item_id, '[' || text || ']' AS prompt, text AS prompt_en FROM benchmark b WHERE item_id % 2 = 0")
def translate_join(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return records.translated(b, b.where("item_id % 2 = 0").withColumn("prompt", F.concat(F.lit("["), "prompt", F.lit("]"))), "item_id", pos="item_id")


@query("coverage_gap", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    return resume.uncovered(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("shared_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def shared_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("presence_audit", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS present FROM documents")
def presence_audit(spark: SparkSession, d: str) -> DataFrame:
    return resume.presence(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("union_tiers", "SELECT doc_id, lang, NULL::BIGINT AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality::BIGINT FROM labels")
def union_tiers(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", F.col("quality").cast("long"))
    return a.unionByName(b, allowMissingColumns=True)


@query("normalize_space", r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85]+', ' ', 'g')) AS clean FROM documents")
def normalize_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean("text").alias("clean"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM pages")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.escape_html("html").alias("safe"))


@query("prompt_render", "SELECT item_id, 'Rate {score} for \"' || text || '\" (' || item_id || ').' AS prompt FROM benchmark")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    t = X.substitute('Rate {score} for "{response}" ({item}).', {"response": F.col("text"), "item": F.col("item_id")}, ["response", "item"])
    return table(spark, d, "benchmark").select("item_id", t.alias("prompt"))


@query("fix_mojibake", "SELECT doc_id, text AS fixed FROM documents")
def fix_mojibake(spark: SparkSession, d: str) -> DataFrame:
    """Breaks every text as a wrong decoding would, and repairs it."""
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", X.fix_mojibake(broken).alias("fixed"))


# vectors and their copies, twice as long and a little turned, so that there are near pairs
TURNED_SQL = """SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding::DOUBLE[], lambda x, i: 2 * x + CASE WHEN i = 1 THEN 0.1 ELSE 0 END) FROM embeddings"""
NEAR_SQL = "SELECT a.vec_id AS a, b.vec_id AS b FROM ({0}) a JOIN ({0}) b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {1}"


#: numbers of a vector of the table
SIZE = 64


def _turned(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    turned = F.transform("embedding", lambda v, i: 2 * v + F.when(i == 0, 0.1).otherwise(0.0))
    return x.unionByName(x.select((F.col("vec_id") + 1000000).alias("vec_id"), turned.alias("embedding")))


@query("semantic_dups", NEAR_SQL.format(TURNED_SQL, 0.92))
def semantic_dups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.semantic_duplicates(_turned(spark, d)).select("a", "b")


@query("semantic_links", NEAR_SQL.format(TURNED_SQL, 0.6))
def semantic_links(spark: SparkSession, d: str) -> DataFrame:
    return dedup.semantic_duplicates(_turned(spark, d), least=0.6).select("a", "b")


@query("semantic_search")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the vectors whose id 20 divides, by an index of all; its recall is held against brute force in the tests."""
    x = semantic.neighbours(_turned(spark, d), F.col("vec_id") % 20 == 0, SIZE)
    return x.select("query", "key", F.round("cosine", 9).alias("cosine"))


@query(
    "parse_sections",
    """SELECT 'WSC_' || item_id AS source, 'What of ' || item_id || '?' AS question,
  trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')) AS answer FROM benchmark""",
)
def parse_sections(spark: SparkSession, d: str) -> DataFrame:
    """Writes each benchmark item as a catechism's question and parses the document again."""
    body = F.regexp_replace("text", r"\n{2,}", "\n")
    doc = F.concat(F.lit("preamble\n\nPergunta "), F.col("item_id").cast("string"), F.lit(". What of\n"), F.col("item_id").cast("string"), F.lit("?\n\nR. "), body, F.lit("\n\nReferências: none\n"))
    return parse_all(table(spark, d, "benchmark").select(F.lit("wsc").alias("doc"), doc.alias("text")), ["wsc"]).select("source", "question", "answer")


@query("jsonl_bad_lines", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_id % 10 <> 0")
def jsonl_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON text of which a tenth is cut off; lines that do not parse are dropped."""
    line = F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    x = table(spark, d, "events").select("event_id", F.from_json(line, "k int, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("j"))
    return x.where("j._corrupt_record IS NULL AND j.k IS NOT NULL").select("event_id", "j.k")
