"""Order-aware deduplication and semantic duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.semantic import unit_vectors
from corpusmill.sources.scratch import written

#: blocks of a file of :func:`semantic_duplicates`
FILE_BLOCKS = 8


def first_wins(rows: DataFrame, key: Column, pos: list[str], keep_empty: bool = False) -> DataFrame:
    """The first row of each key by ``pos``. Rows with an empty key are all kept if ``keep_empty``.

    A minimum over positions, combined before the shuffle, so that a key with very many rows is no task's burden;
    positions must be unique.
    """
    x = rows.withColumn("_k", key).withColumn("_p", F.struct(*pos))
    keyed = x.where(F.coalesce(F.col("_k"), F.lit("")) != "") if keep_empty else x
    first = keyed.groupBy("_k").agg(F.min("_p").alias("_p")).select("_p")
    out = keyed.join(first, "_p", "left_semi")
    if keep_empty:
        out = out.unionByName(x.where(F.coalesce(F.col("_k"), F.lit("")) == ""))
    return out.drop("_k", "_p")


def duplicate_report(rows: DataFrame, key: str) -> DataFrame:
    """One row: number of non-empty keys that occur more than once, and of the rows that have them."""
    n = rows.where(F.col(key) != "").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_affected"))


def prefer_valid(rows: DataFrame, key: str = "prompt_id", score: str = "judge_score", seq: str = "seq") -> DataFrame:
    """The latest row of each key among those with a score, or else the latest; ``pos`` is the key's first place.

    Rows without a key pass through, with no ``pos``: they come last.
    """
    names = [c for c in rows.columns if c != key]
    keyed = rows.where(F.col(key).isNotNull())
    best = keyed.groupBy(key).agg(
        F.max_by(F.struct(*names), F.struct(F.col(score).isNotNull(), F.col(seq))).alias("_r"),
        F.min(seq).alias("pos"),
    )
    best = best.select(key, *[F.col(f"_r.{c}").alias(c) for c in names], "pos")
    return best.unionByName(rows.where(F.col(key).isNull()).withColumn("pos", F.lit(None).cast(rows.schema[seq].dataType)))


def lines_first_wins(lines: DataFrame, line: str, pos: str, key: Column) -> DataFrame:
    """First-wins over the records of a file of JSON lines; malformed lines (``key`` is null) stay."""
    x = lines.withColumn("_key", key)
    good = first_wins(x.where(F.col("_key").isNotNull()), F.col("_key"), [pos])
    return good.unionByName(x.where(F.col("_key").isNull())).drop("_key").orderBy(pos)


def semantic_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.92, block: int = 2048) -> DataFrame:
    """Pairs (a < b, cosine) of vectors at ``least`` or more: an exact search, in blocks.

    Vectors are dealt into blocks of ``block`` rows, one row each, and written once; pairs of blocks are the Cartesian product of that table with itself, which
    reads it again instead of shuffling it. So what is shuffled and written grows with the rows, and a task holds one file split and a few pairs of blocks.
    The comparisons are those of a flat index: they grow with the square of the rows; :mod:`semantic` searches below that.
    Vectors that are not as long as most are, that have nulls or nothing but zeros, match nothing; nor do those without a key.
    """
    unit = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    size, n = unit.agg(F.coalesce(F.mode(F.size("v"), deterministic=True), F.lit(0)), F.count("*")).first()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held = TaskContext.get().partitionId(), 0, []

        def out(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            k, v = (np.concatenate(x) for x in zip(*rows, strict=True))
            cols = [pa.array([(part << 32) | no], pa.int64()), pa.array([k.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["b", "k", "v"])

        for batch in batches:
            v, at = unit_vectors(batch.column(1), size)
            k = batch.column(0).to_numpy()[at]
            while len(k):
                take = block - sum(len(x) for x, _ in held)
                held.append((k[:take], v[:take]))
                k, v = k[take:], v[take:]
                if sum(len(x) for x, _ in held) == block:
                    yield out(held)
                    no, held = no + 1, []
        if held:
            yield out(held)

    dealt = unit.repartition(max(1, -(-n // (FILE_BLOCKS * block))), "k")
    blocks = written(dealt.mapInArrow(packed, "b long, k binary, v binary"), "vector-blocks")
    x, y = (blocks.select(*[F.col(c).alias(c + side) for c in ("b", "k", "v")]) for side in "xy")
    # of two blocks' two pairs the one that spreads work over all splits; a block with itself once
    once = (F.col("bx") == F.col("by")) | ((F.col("bx") < F.col("by")) == (F.xxhash64(F.least("bx", "by"), F.greatest("bx", "by")) % 2 == 0))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bx, kx, vx, by, ky, vy = (batch.column(c)[row] for c in range(6))
                kx, ky = (np.frombuffer(k.as_buffer(), np.int64) for k in (kx, ky))
                vx, vy = (np.frombuffer(v.as_buffer(), np.float64).reshape(-1, size) for v in (vx, vy))
                # single precision tells what is far below the limit; the rest is decided in double precision
                i, j = np.nonzero(vx.astype(np.float32) @ vy.astype(np.float32).T >= least - 1e-4)
                same = bx.as_py() == by.as_py()
                for z in range(0, len(i), 1 << 16):
                    p, q = i[z : z + (1 << 16)], j[z : z + (1 << 16)]
                    ok = (kx[p] < ky[q]) if same else (kx[p] != ky[q])
                    p, q = p[ok], q[ok]
                    cos = np.einsum("ij,ij->i", vx[p], vy[q])
                    ok = cos >= least
                    a, b = kx[p[ok]], ky[q[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cos[ok])], names=["a", "b", "cosine"])

    return x.crossJoin(y).where(once).mapInArrow(near, "a long, b long, cosine double")
