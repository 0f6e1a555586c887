"""Search for vectors of like direction by random hyperplanes, below all pairs.

The sides of ``bits`` random hyperplanes that a vector lies on are its bucket; vectors at an angle a share a side with probability 1 - a / pi. A bucket
of so many bits that it holds some ``bucket`` vectors, in as many tables as it takes to find a pair at the limit with probability ``recall``, replaces
the comparison with all rows: n rows cost n to a power of about 1.2 at a cosine of 0.92. Every candidate is decided by its cosine.

Hyperplanes are drawn from a seed and no sample of the rows. Buckets that hold more than ``bucket`` rows are cut into pieces that meet all queries of
the bucket, so no task holds more than a piece and a batch of queries. Rows are never dropped from a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_vectors(lists: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 as rows, and which of the lists they are: those of ``size`` numbers, none of them null, and not all of them zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    off = lists.offsets.to_numpy()
    values = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    fit = np.flatnonzero((np.diff(off) == size) & lists.is_valid().to_numpy(zero_copy_only=False))
    v = values[off[fit][:, None] + np.arange(size)] if len(fit) else np.zeros((0, size))
    norm = np.sqrt((v * v).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return v[ok] / norm[ok, None], fit[ok]


def tables_needed(bits: int, least: float, recall: float) -> int:
    """How many tables find a pair at cosine ``least`` with probability ``recall``."""
    share = (1 - math.acos(least) / math.pi) ** bits
    return 1 if share >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def neighbours(vectors: DataFrame, asked: Column, size: int, key: str = "vec_id", vector: str = "embedding", least: float = 0.92, recall: float = 0.97, bucket: int = 1024, seed: int = 7) -> DataFrame:
    """(query, key, cosine) of rows at ``least`` or more from the rows that ``asked`` holds for, by an index of all rows; no row is its own neighbour.

    Vectors of other lengths than ``size``, with nulls, and of nothing but zeros have no direction and no neighbours. Keys are longs. Of equal keys each row is
    compared, and a pair is reported once with its highest cosine.
    """
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.coalesce(asked, F.lit(False)).alias("q"))
    bits = max(1, math.ceil(math.log2(max(2, rows.count() / bucket))))
    n_tables = tables_needed(bits, least, recall)
    planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((n_tables * bits, size))
    weights = (1 << np.arange(bits, dtype=np.int64))[None, None, :]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, at = unit_vectors(b.column(1), size)
            sides = (v @ planes.T >= 0).reshape(len(at), n_tables, bits)
            places = (sides * weights).sum(2)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w), pa.array(x.ravel())) for x, w in ((v, size), (places, n_tables))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), lists[0], b.column(2).take(pa.array(at)), lists[1]], names=["k", "v", "q", "places"])

    x = rows.mapInArrow(placed, "k long, v array<double>, q boolean, places array<long>").select("k", "v", "q", F.posexplode("places").alias("t", "b"))
    sizes = x.groupBy("t", "b").agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).where("nq > 0").select("t", "b", F.ceil(F.col("n") / bucket).alias("pieces"))
    x = x.join(sizes, ["t", "b"])
    base = x.select("t", "b", F.pmod(F.xxhash64("k"), "pieces").alias("piece"), "k", "v", F.lit(False).alias("q"))
    queries = x.where("q").select("t", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "k", "v", F.lit(True).alias("q"))

    def near(t: pa.Table) -> pa.Table:
        v, at = unit_vectors(t.column("v"), size)
        k, q = t.column("k").to_numpy(zero_copy_only=False)[at], t.column("q").to_numpy(zero_copy_only=False).astype(bool)[at]
        found = []
        rest = v[~q].T
        for a in range(0, int(q.sum()), bucket):
            cos = v[q][a : a + bucket] @ rest
            i, j = np.nonzero(cos >= least)
            found.append((k[q][a + i], k[~q][j], cos[i, j]))
        a, b, c = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": a[a != b], "key": b[a != b], "cosine": c[a != b]})

    met = base.unionByName(queries).groupBy("t", "b", "piece").applyInArrow(near, "query long, key long, cosine double")
    return met.groupBy("query", "key").agg(F.max("cosine").alias("cosine"))
