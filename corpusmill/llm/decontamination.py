"""Benchmark decontamination (operator 8).

The n-grams of the normalised benchmark items (an item of fewer words is one n-gram of its own) are broadcast as
sorted arrays of hashes. Every document is scanned once, as a sequence of word hashes: for each
length of n-gram, windows are looked up by binary search; what is found is verified by its words.
The benchmark is a stated, bounded query set; beyond ``most_bytes`` it is broken into blocks of at most that size, each is
scanned against all documents, and findings are merged by row.

Cases: a null text or item has no words and matches nothing; equal items all count, repeated item ids once, a null id as the
empty string; documents may repeat, each row is its own; very long texts are scanned whole; an empty
benchmark hits nothing; other columns pass through, under any name where rows are removed; where findings are added, they replace ``_hit_*``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _seq
from corpusmill.llm._spark import apart, with_place


class Index:
    """n-grams of items, by length: sorted hashes, the n-grams' words, and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], gram: int):
        ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(ids)}
        grams: dict[int, dict[bytes, set[int]]] = {}
        for item, text in items:
            buf, off = _seq.buffers(pa.array([text or ""]))
            w = _seq.Words(_seq.LOWER[buf], off, _seq.ALNUM)
            n = len(w.start)
            size = min(n, gram)
            for k in range(n - size + 1 if n else 0):
                line = b" ".join(bytes(w.buf[a:b]) for a, b in zip(w.start[k : k + size], w.end[k : k + size], strict=True))
                grams.setdefault(size, {}).setdefault(line, set()).add(number[item])
        self.ids, self.by_size = ids, {}
        for size, lines in grams.items():
            keys = list(lines)
            buf, off = _seq.buffers(pa.array(keys, pa.binary()))
            w = _seq.Words(buf, off, _seq.ALNUM)
            at = np.arange(0, len(w.start), size)
            h = _seq.Rolling(w.values(0), 0).of(at, at + size)
            order = np.argsort(h)
            self.by_size[size] = (h[order], [keys[i] for i in order], [sorted(lines[keys[i]]) for i in order])

    def scan(self, texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
        """For each text: number of words, first and end word of each maximal hit run, ids of the items found."""
        data, offs = _seq.buffers(texts)
        for a, b in _seq.cuts(offs, most):
            off = offs[a : b + 1] - offs[a]
            w = _seq.Words(_seq.LOWER[data[offs[a] : offs[b]]], off, _seq.ALNUM)
            starts: list[list[int]] = [[] for _ in range(b - a)]
            ends: list[list[int]] = [[] for _ in range(b - a)]
            items: list[set[int]] = [set() for _ in range(b - a)]
            roll = _seq.Rolling(w.values(0), 0) if self.by_size else None
            for size, (hashes, lines, owners) in self.by_size.items():
                at = np.arange(max(0, len(w.start) - size + 1))
                h = roll.of(at, at + size)
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                for i in np.flatnonzero(hashes[place] == h):
                    doc = int(np.searchsorted(w.off, i, "right")) - 1
                    if i + size > w.off[doc + 1]:
                        continue
                    line = b" ".join(bytes(w.buf[x:y]) for x, y in zip(w.start[i : i + size], w.end[i : i + size], strict=True))
                    k = int(place[i])
                    while k < len(hashes) and hashes[k] == h[i]:
                        if lines[k] == line:
                            starts[doc].append(int(i - w.off[doc]))
                            ends[doc].append(int(i - w.off[doc]) + size)
                            items[doc].update(owners[k])
                        k += 1
            for doc in range(b - a):
                s, e = _seq.union(np.array(starts[doc], np.int64), np.array(ends[doc], np.int64))
                yield int(w.off[doc + 1] - w.off[doc]), s, e, [self.ids[x] for x in sorted(items[doc])]


def _blocks(benchmark: DataFrame, item: str, text: str, most_bytes: int) -> list[DataFrame]:
    b = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).distinct()
    size = b.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    n = max(1, -(-size // most_bytes))
    return [b] if n == 1 else [b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", gram: int = 10, most_bytes: int = 1 << 22) -> DataFrame:
    """``df`` with _hit_words (number of words), _hit_starts, _hit_ends (runs of hit words) and _hit_items."""
    spark = df.sparkSession
    df = df.drop("_hit_words", "_hit_starts", "_hit_ends", "_hit_items", "_hit_row")
    blocks = _blocks(benchmark, item, item_text, most_bytes)
    kept = df.schema.fields
    names = ["_hit_words", "_hit_starts", "_hit_ends", "_hit_items"]
    schema = df.select("*", F.lit(0).cast("long").alias(names[0]), *[F.array().cast(t).alias(n) for n, t in zip(names[1:], ("array<int>", "array<int>", "array<string>"), strict=True)]).schema
    at = [f.name for f in kept].index(text)

    def scanned(block: DataFrame, rows: DataFrame, width: int, out) -> DataFrame:
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in block.collect()], gram))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, s, e, i = zip(*index.value.scan(b.column(at)), strict=True) if b.num_rows else ((), (), (), ())
                found = [pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int32())), pa.array(e, pa.list_(pa.int32())), pa.array(i, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:width], *found], names=[*b.schema.names[:width], *names])

        return rows.mapInArrow(run, out)

    if len(blocks) == 1:
        return scanned(blocks[0], df, len(kept), schema)
    numbered = with_place(df, "_hit_row", "hit-input")
    wide = numbered.withColumns({n: F.lit(None).cast(schema[n].dataType) for n in names}).schema
    parts = [scanned(b, numbered, len(kept) + 1, wide).select("_hit_row", *names) for b in blocks]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("_hit_row").agg(
        F.max(names[0]).alias(names[0]),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col(names[1]).alias("s"), F.col(names[2]).alias("e"))))).alias("_hit_runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[3])))).alias(names[3]),
    )
    run = F.aggregate(
        "_hit_runs",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda a, r: F.when(
            (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))), a), -1)["e"] >= r["s"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["s"].alias("s"), F.greatest(F.get(a, F.size(a) - 1)["e"], r["e"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(F.struct(r["s"].alias("s"), r["e"].alias("e"))))),
    )
    merged = merged.withColumn("_hit_runs", run).withColumns({names[1]: F.col("_hit_runs.s"), names[2]: F.col("_hit_runs.e")}).drop("_hit_runs")
    return numbered.join(merged, "_hit_row").select(*[numbered[f.name] for f in kept], *names)


def hit_words() -> Column:
    """Number of hit words in a row of :func:`find_contamination`."""
    spans = F.zip_with("_hit_starts", "_hit_ends", lambda s, e: e - s)
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, n: a + n)


def remove_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``df`` without the rows whose text has any hit word."""
    return apart(df, (options.get("text", "text"),), lambda x: find_contamination(x, benchmark, **options).where(F.size("_hit_starts") == 0))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    x = x.withColumn("n_hit", hit_words())
    return x.select(
        "doc_id",
        F.col("_hit_words").alias("n_words"),
        "n_hit",
        F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
