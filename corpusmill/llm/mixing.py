"""Mixing sources to target weights (operator 4).

The words of a source, in a fixed order of its documents, form one stream, cut into blocks of
``block`` words. The mix is a sequence of slots, dealt to output shards. For each shard, every source gets the whole
part of its expected number of slots, and a multinomial draw with the fractional parts as
weights deals out the rest. The slots of a source, counted over all shards, run through a pseudorandom permutation of its
block indexes (a Feistel network with cycle walking), another one for each pass over the source, and are joined
with the blocks by (source, index). A pass takes each block once and there are at most ``most`` passes, so no
document is taken more often. Seeds are parameters: reruns agree.

Cases: null sources are one source, last in order; a null or empty text has size 0 and nothing to
take; repeated rows are rows of their own; if all sizes are 0, targets are 0; an empty table gives an empty result;
columns other than the id, text and source are not read, and go along under any name where texts are mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm._spark import SPACE, apart, materialize, pieces, running_offset, with_place

BLOCK, SLOTS, MOST, SEED, STRETCH = 32, 1 << 14, 3, 17, 1024


def permuted(index: np.ndarray, n: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Where a permutation of range(n), chosen by ``seed``, sends ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, rounds, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + np.uint64(1)) * k
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source: source, rank, source_size, target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. The level L at which the sum of
    min(most * size, L * weight) is the sum of all sizes is what resharing the excess until none is above comes to.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", F.col("rank") % 3 + 1)
    everything = Window.partitionBy()
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("all", F.sum("source_size").over(everything))
    tightest = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(tightest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("w").over(tightest.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    ratio = F.col("cap") / F.col("w")
    level = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), F.col("rank"), F.col("level")))).over(everything)
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), level["level"] * F.col("w")))
    return s.select("source", F.col("rank").cast("long").alias("rank"), "source_size", "target")


def _draw(seed: int):
    def draw(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("rank")
        g = np.random.Generator(np.random.PCG64([seed, int(x["shard"].iloc[0])]))
        expected = x["expected"].to_numpy()
        whole = np.floor(expected)
        part = expected - whole
        rest = int(round(part.sum()))
        counts = whole.astype(np.int64)
        if rest:
            counts = counts + g.multinomial(rest, part / part.sum())
        return x.assign(count=counts)[["shard", "rank", "count", "n_blocks"]]

    return draw


def _slots(seed: int, most: int):
    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at = np.arange(r.begin, min(r.begin + r.count, most * r.n_blocks))
                for p in np.unique(at // r.n_blocks) if len(at) else ():
                    own = at[at // r.n_blocks == p] - p * r.n_blocks
                    yield pd.DataFrame({"rank": r.rank, "shard": r.shard, "pass_no": int(p), "block_no": permuted(own, int(r.n_blocks), hash_seed(seed, r.rank, int(p)))})

    return slots


def hash_seed(*parts: int) -> int:
    return int(np.random.SeedSequence([int(x) for x in parts]).generate_state(1, np.uint64)[0])


def draw_blocks(sources: DataFrame, block: int, slots: int, most: int, seed: int, parts: int) -> DataFrame:
    """(rank, shard, pass_no, block_no) for every slot of the mix."""
    s = sources.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("slots", F.col("target") * F.col("n_blocks") / F.col("source_size"))
    s = s.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / slots)).cast("long"))
    # shards in two steps, so that no row holds a list of all and tasks share the work
    s = s.select("rank", "n_blocks", "shards", (F.col("slots") / F.col("shards")).alias("expected"), F.explode(F.expr(f"sequence(0L, (shards - 1) div {STRETCH})")).alias("stretch"))
    each = s.repartition(parts, "rank", "stretch").withColumn("shard", F.explode(F.expr(f"sequence(stretch * {STRETCH}, least((stretch + 1) * {STRETCH}, shards) - 1)")))
    drawn = each.select("rank", "n_blocks", "expected", "shard").groupBy("shard").applyInPandas(_draw(seed), "shard long, rank long, count long, n_blocks long")
    drawn = running_offset(drawn, ["rank"], ["shard"], F.col("count"), "begin", parts)
    return drawn.repartition(parts, "rank", "shard").mapInPandas(_slots(seed, most), "rank long, shard long, pass_no int, block_no long")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, slots: int = SLOTS, most: int = MOST, seed: int = SEED, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, taken).

    rows: row (a number for each row of ``df``), key, size, source, rank, source_size, target. Documents of a source follow each other in
    the order of a hash, ``order`` or that of key and text, so that a rerun on other files takes the same.
    taken: row, shard, pass_no, first and end (words of the document, from 0): the parts of it that the mix takes.
    """
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")).cast("long")
    rows = materialize(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), (F.xxhash64(key, text) if order is None else order).alias("sort")), "mix-sizes")
    sources = materialize(targets(rows, most), "mix-targets")
    rows_s = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = running_offset(rows_s.where("size > 0").select("row", "rank", "size", "sort"), ["rank"], ["sort", "row"], F.col("size"), "begin", pieces(df, 4, 256), ["sort"])
    part = placed.select("row", "rank", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block_no"))
    part = part.select("row", "rank", "block_no", (F.greatest(F.col("block_no") * block, F.col("begin")) - F.col("begin")).alias("first"), (F.least((F.col("block_no") + 1) * block, F.col("begin") + F.col("size")) - F.col("begin")).alias("end"))
    # written, as are the spans of mixed texts: in one plan all their shuffles would be planned anew and run at once
    drawn = materialize(draw_blocks(sources, block, slots, most, seed, pieces(df, 8, 16)), "mix-slots")
    # Catalyst takes what comes from Python for as small as what went in; a broadcast would grow with the corpus
    taken = part.join(drawn.hint("merge"), ["rank", "block_no"]).select("row", "shard", "pass_no", "first", "end")
    return rows_s.drop("sort"), taken


def mixed_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df`` as the mix takes them: one row per document and pass, with what is taken of its text.

    A document of which a pass takes every word keeps its text as it is; otherwise its taken words are joined by spaces.
    """
    return apart(df, (key, text, source), lambda x: _mixed(x, key, text, source, **options))


def _mixed(df: DataFrame, key: str, text: str, source: str, **options) -> DataFrame:
    numbered = with_place(df, "_mix_row", "mix-input")
    rows, taken = mix(numbered.withColumn("_mix_key", F.col("_mix_row")), "_mix_key", text, source, order=F.xxhash64(key, text), **options)
    spans = taken.groupBy("row", "pass_no").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("_mix_spans"), F.sum(F.col("end") - F.col("first")).alias("_mix_taken"))
    spans = spans.join(rows.select("row", F.col("key").alias("_mix_row"), F.col("size").alias("_mix_size")), "row").drop("row", "pass_no")
    spans = materialize(spans, "mix-spans")
    x = numbered.join(spans.hint("merge"), "_mix_row")
    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")
    some = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_mix_spans", lambda s: F.slice(w, (s["first"] + 1).cast("int"), (s["end"] - s["first"]).cast("int")))), " ")), 0)
    return x.withColumn(text, F.when(F.col("_mix_taken") == F.col("_mix_size"), F.col(text)).otherwise(some)).drop("_mix_row", "_mix_spans", "_mix_taken", "_mix_size")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows, taken = mix(docs)
    per_row = taken.groupBy("row").agg(F.sum(F.col("end") - F.col("first")).alias("taken"))
    return rows.join(per_row, "row", "left").select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
