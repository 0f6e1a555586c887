"""Filters, scores and joins of corpus curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import half_even, strip


def not_blank(c: Column | str) -> Column:
    return F.length(strip(c)) > 0


def with_sidecar(docs: DataFrame, sidecars: DataFrame, key: str, score: str, least: float = 93) -> DataFrame:
    """Documents whose sidecar has at least ``least``, and those without one; a sidecar without a score has 0."""
    s = sidecars.select(key, F.coalesce(score, F.lit(0)).alias(score), F.lit(True).alias("_has"))
    return docs.join(s, key, "left").where(F.col("_has").isNull() | (F.col(score) >= least)).drop("_has")


def coalesced_scores(labels: DataFrame, keys: DataFrame, key: str = "prompt_id", score: str = "judge_score") -> DataFrame:
    """Labels with the judge's score: the row's own, else the key file's."""
    k = keys.select(key, F.col(score).alias("_k"))
    own = F.col(score) if score in labels.columns else F.lit(None).cast("int")
    return labels.join(k, key, "left").withColumn(score, F.coalesce(own, F.col("_k"))).drop("_k")


def excluded(rows: DataFrame, author: str, names: list[str]) -> DataFrame:
    """Rows by none of ``names``."""
    return rows.where(~F.col(author).isin(names) | F.col(author).isNull())


def quality_band(score: Column) -> Column:
    return F.when(score >= 93, "include").when(score >= 80, "review").otherwise("discard")


def weighted_rubric(parts: dict[str, float], digits: int = 1) -> Column:
    total = F.lit(0.0)
    for name, w in parts.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return half_even(total, digits)


def checklist_score(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct (score, verdict) of four checks that weigh .25, .30, .25 and .20: include from .85, review from .70."""
    score = sum((x.cast("double") * w for x, w in zip((a, b, c, d), (0.25, 0.30, 0.25, 0.20), strict=True)), F.lit(0.0))
    return F.struct(score.alias("score"), F.when(score >= 0.85, "include").when(score >= 0.70, "review").otherwise("discard").alias("verdict"))


def dispute_level(scores: DataFrame, item: str, score: str, line: float = 0.70) -> DataFrame:
    """How reviewers of an item disagree: minor where all are above the line, moderate where it lies between them."""
    low, high = F.min(score), F.max(score)
    level = F.when(low == high, "none").when(low >= line, "minor").when(high >= line, "moderate").otherwise("rejected")
    return scores.groupBy(item).agg((high - low).alias("spread"), F.avg(score).alias("mean_score"), level.alias("dispute"))


def acceptable_answers(rows: DataFrame, text: str, low: int, high: int, rejected: list[str]) -> DataFrame:
    """Rows whose text has ``low`` to ``high`` characters and none of the phrases, in any case."""
    ok = F.length(text).between(low, high)
    for phrase in rejected:
        ok = ok & ~F.contains(F.lower(text), F.lit(phrase.lower()))
    return rows.where(ok)


def chunk_outcomes(accepted: DataFrame, chunk: str, asked: int = 2) -> DataFrame:
    """Accepted and rejected answers of each chunk, of ``asked`` that were wanted."""
    return accepted.groupBy(chunk).agg(F.count_if("ok").alias("accepted")).withColumn("rejected", F.greatest(F.lit(0), F.lit(asked) - F.col("accepted")))


def tallies(rows: DataFrame, status: str, key: str) -> DataFrame:
    """One row: kept, dropped and distinct kept keys."""
    ok = F.col(status).isin("ok", "edit")
    return rows.agg(F.count_if(ok).alias("kept"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("dropped"), F.count_distinct(F.when(ok, F.col(key))).alias("unique_keys"))


def without_source(rows: DataFrame, source: str, name: str) -> DataFrame:
    """An ablation: all rows but those of one source."""
    return rows.where(~F.col(source).eqNullSafe(F.lit(name)))


def prices(usage: DataFrame, table: DataFrame, model: str = "model", tokens: str = "total_tokens", key: str = "row_id") -> DataFrame:
    """Cost of each row by the price of the longest key that is the model's name or a prefix of it before a hyphen; else the default's.

    The join is on equality: a name is exploded into its prefixes at hyphens, so the price table may be of any size.
    """
    parts = F.split(model, "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    x = usage.select(key, model, tokens, F.explode(prefixes).alias("prefix"))
    best = x.join(table.where("key <> 'default'"), F.col("prefix") == F.col("key")).groupBy(key).agg(F.max_by("price", F.length("prefix")).alias("_price"), F.max(F.struct(F.length("prefix"), "prefix"))["prefix"].alias("price_key"))
    default = table.where("key = 'default'").select("price").scalar()
    return usage.join(best, key, "left").withColumn("price", F.coalesce("_price", default)).withColumn("cost", F.col(tokens) * F.col("price")).drop("_price")


def first_sources(chunks: DataFrame, source: str, pos: str, most: int) -> DataFrame:
    """The chunks of the first ``most`` sources in order of first appearance; a null source is one of them."""
    order = chunks.groupBy(F.col(source).alias("_s")).agg(F.min(pos).alias("_first")).orderBy("_first").limit(most)
    return chunks.join(order, F.col(source).eqNullSafe(F.col("_s")), "left_semi")


def cheapest(offers: DataFrame, price: str, tie: str, most: int = 10, missing: float = 999.0) -> DataFrame:
    """The ``most`` cheapest offers; one without a price goes as ``missing``."""
    return offers.orderBy(F.coalesce(F.col(price), F.lit(missing)), tie).limit(most)
