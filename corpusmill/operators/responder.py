"""Calls to a language model as a table operation: one reply per prompt, resumable, retried, with a stub for offline use."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import ordered
from corpusmill.operators.resume import remaining
from corpusmill.sources.scratch import written
from corpusmill.sources.versions import append_batch, batches

REPLY = "prompt_id string, reply string, error string"


def stub(prompt: str) -> str:
    """A reply that depends on the prompt alone: a chat response with a rating from 1 to 7."""
    n = int(hashlib.sha256(prompt.encode()).hexdigest(), 16)
    return json.dumps({"model": "stub", "choices": [{"message": {"content": f"Rating: {1 + n % 7}"}}], "usage": {"total_tokens": len(prompt.split())}})


def respond(
    prompts: DataFrame, call: Callable[[str], str] = stub, key: str = "prompt_id", prompt: str = "prompt", lanes: int = 8, attempts: int = 5, wait: float = 4.0, longest: float = 60.0, at_once: int = 1
) -> DataFrame:
    """(prompt_id, reply, error) of every prompt. A call that keeps failing gives its error.

    ``lanes`` tasks work at the same time, each with ``at_once`` calls under way; replies come in the order of prompts, so a batch's slowest call
    holds up its task only.
    """

    def ask(p: str) -> tuple[str | None, str | None]:
        for n in range(attempts):
            try:
                return call(p), None
            except (OSError, TimeoutError) as e:
                error = repr(e)
                if n + 1 < attempts:
                    time.sleep(min(longest, wait * 2**n))
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                replies = list(pool.map(ask, b["prompt"]))
                yield pd.DataFrame({"prompt_id": b["prompt_id"], "reply": [r for r, _ in replies], "error": [e for _, e in replies]})

    asked = prompts.select(F.col(key).cast("string").alias("prompt_id"), F.col(prompt).alias("prompt"))
    return asked.repartition(lanes).mapInPandas(run, REPLY)


def respond_within(prompts: DataFrame, log: str, limit: float, most: float, cost: Column, order: str, wave: int = 1000, key: str = "prompt_id", **options) -> DataFrame:
    """Replies to prompts in ``order`` for ``limit`` at the most, a wave of calls at a time; (prompt_id, reply, error, cost, batch).

    ``most`` bounds what a call can cost, so a wave is only as large as what is left allows, and no call is made that could go over the limit. Each wave
    is added to ``log`` at once or not at all: a run that was ended goes on behind its last wave, with what that left.
    ``cost``: of a reply.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    spark = prompts.sparkSession
    schema = T._parse_datatype_string(REPLY + ", cost double")
    ranked = ordered.with_ranks(prompts, [order], "_rank")
    ranked = written(ranked, "waves")
    total, asked, spent, no = ranked.count(), 0, 0.0, 0
    while True:
        done = batches(spark, log, schema).where(F.col("batch") == no).agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent")).first()
        if not done["n"]:
            size = min(wave, total - asked, int((limit - spent) // most))
            if size <= 0:
                break
            replies = respond(ranked.where(F.col("_rank").between(asked + 1, asked + size)), key=key, **options)
            append_batch(replies.withColumn("cost", F.coalesce(cost.cast("double"), F.lit(0.0))), log, no)
            continue
        asked, spent, no = asked + done["n"], spent + done["spent"], no + 1
    return batches(spark, log, schema)


def resume(prompts: DataFrame, results: DataFrame, **options) -> DataFrame:
    """Replies to the prompts that have no scored result."""
    return respond(remaining(prompts, results), **options)
