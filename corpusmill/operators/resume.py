"""Resuming runs: what is left to do, coverage, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import ordered


def remaining(prompts: DataFrame, results: DataFrame, key: str = "prompt_id", score: str = "judge_score") -> DataFrame:
    """Prompts without a scored result; a result without a score does not count as done."""
    return prompts.join(results.where(F.col(score).isNotNull()).select(key), key, "left_anti")


def pending_parse(prompts: DataFrame, results: DataFrame, key: str = "prompt_id", score: str = "judge_score") -> DataFrame:
    """Prompts that have results, none of them scored."""
    return remaining(prompts, results, key, score).join(results.select(key), key, "left_semi")


def remaining_chunks(chunks: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str = "chunk_hash") -> DataFrame:
    return chunks.join(accepted.select(key).unionByName(rejected.select(key)), key, "left_anti")


def seeded_chunks(chunks: DataFrame, records: DataFrame, source: str) -> DataFrame:
    """Chunks of sources that have records already: to be counted as done where no log exists."""
    return chunks.join(records.select(source), source, "left_semi")


def progress(chunks: DataFrame, done: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """One row: total, done, remaining."""
    x = chunks.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    n = F.count_if(F.col("_done").isNotNull())
    return x.agg(F.count("*").alias("total"), n.alias("done"), (F.count("*") - n).alias("remaining"))


def uncovered(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of ``required`` that ``found`` lacks, each once."""
    return required.select(key).subtract(found.select(key))


def presence(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``required`` with ``present``."""
    f = found.select(key).distinct().withColumn("_p", F.lit(True))
    return required.join(f, key, "left").withColumn("present", F.col("_p").isNotNull()).drop("_p")


def within_budget(rows: DataFrame, cost: str, order: str, limit: float, run: list[str] | None = None) -> DataFrame:
    """Rows of each run up to the one at which the running total exceeds ``limit``; that row is not emitted.

    A run is one window, so one task's work. Without ``run`` all rows are one, and scanned by ranges of the order (:mod:`ordered`).
    """
    if not run:
        return ordered.within_budget(rows, cost, [order], limit)
    w = Window.partitionBy(*(run or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("spent", F.sum(cost).over(w))
    over = F.max((F.col("spent") > limit).cast("int")).over(w)
    return x.withColumn("_over", over).where("_over = 0").drop("_over")


def reject_legacy(results: DataFrame) -> DataFrame:
    """``results``, or a failure while running if any row has the old schema (judge_reasoning without judge_rationale)."""
    cols = results.columns
    if "judge_reasoning" not in cols:
        return results
    rationale = F.col("judge_rationale").isNull() if "judge_rationale" in cols else F.lit(True)
    old = F.col("judge_reasoning").isNotNull() & rationale
    return results.where(F.when(old, F.raise_error(F.lit("results on the old scale cannot be merged")).cast("boolean")).otherwise(F.lit(True)))


def placement(summary: DataFrame) -> DataFrame:
    """``summary`` (n_scored, mode, lang) with whether it may be placed on the public leaderboard, and why not."""
    why = F.when(F.col("n_scored") <= 0, "no scored records").when(F.col("mode") != "noprompt", "system prompt in use").when(F.col("lang") != "en", "translated track")
    return summary.withColumn("placed", why.isNull()).withColumn("placement_note", why)


def _status(a: str, b: str) -> Column:
    of = lambda c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return F.when(~(of("judge_model") & of("judge_max_tokens")), "incomparable").when(~of("served"), "snapshot drift").otherwise("comparable").alias("status")


def comparability_by(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, status) of the summaries that both sides have: whether they may be compared; another served snapshot is a warning only."""
    side = lambda d, name: d.select(*by, F.struct("judge_model", "judge_max_tokens", "served").alias(name))
    return side(a, "a").join(side(b, "b"), by).select(*by, _status("a", "b"))


def comparability(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the same of two one-row summaries."""
    side = F.struct("judge_model", "judge_max_tokens", "served")
    return a.select(side.alias("a"), b.select(side).scalar().alias("b")).select(_status("a", "b"))
