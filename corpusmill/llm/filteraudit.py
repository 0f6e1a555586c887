"""Audit of how filters interact (operator 12): what each of several filters removes in every order of applying them.

A document's failures are one mask of bits, so all orders follow from counts by (part, mask): a filter removes, at its step, the masks that hold its
bit and none of the steps before. Rows are counted by mask before any order is looked at.

Exact duplicates are found by partition refinement: documents are split by code-point length, then by the hash of one block of text after
another, and whoever is alone in its part drops out after each split. The full texts of those left over are compared, and all but the smallest id fail.
Only lengths and hashes are shuffled until then; the texts of the rest are read once more.

Cases: a null text is an empty one; a null part is the empty string, and one with it; a null id is no smaller than any and fails for no one; of
rows with equal ids and texts none fails for the other; several labels of one id count as the highest; an empty table has no parts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm._spark import SPACE, bit, bitmap, marked, materialize

#: where blocks of code points end; the last block is the rest of the text
BLOCKS = (64, 1024)


def rules(text: Column) -> dict[str, Column]:
    """The failure conditions of filters A to D."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def split_keys(text: Column) -> list[Column]:
    """What the partition is refined by: the length, then the hash of each block."""
    edges = [0, *BLOCKS]
    ends = [F.lit(y - x) for x, y in zip(edges, edges[1:], strict=False)] + [F.length(text)]
    return [F.length(text).cast("long"), *[F.xxhash64(F.substr(text, F.lit(x + 1), y)) for x, y in zip(edges, ends, strict=True)]]


def refined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The combinations of ``keys`` that several rows share, found by one key after another."""
    alive = rows.select(*keys)
    for k in range(1, len(keys) + 1):
        some = alive.groupBy(*keys[:k]).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        if k == len(keys):
            return some
        alive = materialize(alive.join(some, keys[:k], "left_semi"), "audit-refined")
    raise ValueError("no keys")


def later_copies(docs: DataFrame, rows: DataFrame, keys: list[str], id: str, text: str, carried: list[str]) -> DataFrame:
    """``id`` and ``carried`` of the rows whose whole text is that of a row with a smaller id."""
    parts = materialize(refined(rows, keys), "audit-parts")
    shared = bitmap(parts.select(F.xxhash64(*keys).alias("_at")), "_at")
    found = docs.select(id, text, *carried, *[k.alias(c) for k, c in zip(split_keys(F.col(text)), keys, strict=True)]).withColumn("_at", F.xxhash64(*keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(shared.value, b.column(b.num_columns - 1).to_numpy())))

    found = found.withColumn("_bit", bit("_at"))
    kept = found.mapInArrow(run, found.schema).drop("_bit", "_at").join(parts.hint("merge"), keys, "left_semi")
    kept = materialize(kept, "audit-texts")
    least = kept.where(F.col(id).isNotNull()).groupBy(*keys, text).agg(F.min(id).alias("_least"))
    return kept.join(least.hint("merge"), [*keys, text]).where(F.col("_least") < F.col(id)).select(id, *carried)


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): all orders of filters A to E."""
    names = "ABCDE"
    flags = labels.groupBy(F.col("doc_id").alias("_label")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    clean = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    keys = ["size", *[f"b{k}" for k in range(len(BLOCKS) + 1)]]
    failed = reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << names.index(k))).otherwise(0) for k, c in rules(F.col("t")).items()])
    light = materialize(clean.select("id", "part", failed.alias("mask"), *[k.alias(c) for k, c in zip(split_keys(F.col("t")), keys, strict=True)]), "audit-rows")
    late = later_copies(clean.select("id", "t", "part", failed.alias("mask")), light, keys, "id", "t", ["part", "mask"])
    # a copy leaves the mask without E and joins that with it
    move = [F.struct("mask", F.lit(-1).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), F.lit(1).alias("n"))]
    moved = late.select("id", "part", F.explode(F.array(*move)).alias("m")).select("id", "part", "m.mask", "m.n")
    every = light.select("id", "part", "mask", F.lit(1).alias("n")).unionByName(moved)
    each = every.join(flags, F.col("id") == F.col("_label"), "left")
    masks = each.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return over_orders(masks, names)


def over_orders(masks: DataFrame, names: str) -> DataFrame:
    """All orders of ``names`` from (part, mask, n, good, toxic): a row for each part, order and step."""
    orders = ["".join(p) for p in permutations(names)]
    steps = [(o, k + 1, 1 << names.index(o[k]), sum(1 << names.index(c) for c in o[:k])) for o in orders for k in range(len(names))]
    at = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, k, own, before in steps]))
    own = F.col("mask").bitwiseAND(F.col("own")) != 0
    free = F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda cond, what="n": F.sum(F.when(cond, F.col(what)).otherwise(0)).cast("long")
    share = F.when(own, F.col("n") * F.floor(F.lit(len(orders)) / F.bit_count("mask"))).otherwise(0)
    x = masks.withColumn("at", at).select("*", "at.*")
    return x.groupBy("part", "filter_order", "step").agg(
        count(~own & free).alias("kept"), count(own & free).alias("removed"), count(own & ~free).alias("redundant"), count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(own & free, "good").alias("good_lost"), count(own & free, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(first_id < d.doc_id, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d JOIN least_id USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, f, len(list_filter(f, lambda x: x)) AS k, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
s AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, e.x, g.x, h.x] AS o FROM s a, s b, s e, s g, s h WHERE len(list_distinct([a.x, b.x, e.x, g.x, h.x])) = 5),
z AS (SELECT list_aggregate(list_transform(o, lambda i: substr('ABCDE', i::INT, 1)), 'string_agg', '') AS filter_order, o, x AS step FROM o, s),
y AS (SELECT part, filter_order, step, n, good, toxic, k, f[o[step]] AS own, len(list_filter(o[1:step - 1], lambda i: f[i])) = 0 AS free FROM c, z)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT own AND free), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND free), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND NOT free), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (own AND free), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND free), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) FILTER (own), 0)::BIGINT AS shapley FROM y GROUP BY ALL
"""
