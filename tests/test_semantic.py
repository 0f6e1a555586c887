"""Search by hyperplanes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, semantic


def vectors(n, size=32, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((n // 6 + 1, size))
    return centre[np.arange(n) // 6] + rng.standard_normal((n, size)) * rng.choice([0.05, 0.2, 0.3], (n, 1))


def table(spark, v):
    return spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)


def pairs(v, least, every=20):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(u[::every] @ u.T >= least)
    return {(int(a) * every, int(b)) for a, b in zip(i, j, strict=True) if a * every != b}


@pytest.mark.parametrize(("n", "bucket"), [(1500, 64), (6000, 64)])
def test_recall_of_queries_against_all_rows(spark, n, bucket):
    v = vectors(n)
    got = semantic.neighbours(table(spark, v), F.col("vec_id") % 20 == 0, 32, bucket=bucket).collect()
    found, want = {(r.query, r.key) for r in got}, pairs(v, 0.92)
    assert len(found) == len(got) and found <= want and len(want) > n // 20
    assert len(found) >= 0.95 * len(want)


def test_hot_buckets_are_cut_and_lose_nothing(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.ones((700, 8)) + rng.standard_normal((700, 8)) * 0.01, rng.standard_normal((300, 8))])
    got = {(r.query, r.key) for r in semantic.neighbours(table(spark, v), F.col("vec_id") % 20 == 0, 8, bucket=50, recall=0.999).collect()}
    want = pairs(v, 0.92)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 20_000


def test_work_grows_by_less_than_the_square(spark):
    """Candidates a query is compared with: rows of its buckets, in expectation n * tables / 2 ** bits."""
    share = []
    for n in (10**4, 10**6, 10**8, 10**10):
        bits = int(np.ceil(np.log2(n / 1024)))
        share.append(semantic.tables_needed(bits, 0.92, 0.97) / 2.0**bits * n)
    assert all(b / a < 100**0.35 for a, b in zip(share, share[1:], strict=False))


def test_odd_vectors_match_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, None), (7, []), (8, [float("nan"), 1.0]), (2, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = semantic.neighbours(df, F.lit(True), 2).collect()
    assert {(r.query, r.key) for r in got} == {(1, 2), (2, 1)} and all(r.cosine == pytest.approx(1) for r in got)
    flat = dedup.semantic_duplicates(df.where("vec_id <> 2 OR embedding[1] = 0"))
    assert {(r.a, r.b) for r in flat.collect()} == {(1, 2)}
    assert semantic.neighbours(df.limit(0), F.lit(True), 2).count() == 0


def test_flat_search_in_blocks_equals_brute_force_and_shuffles_no_block_pairs(spark):
    v = np.concatenate([vectors(700), np.ones((90, 32)) + np.random.default_rng(3).standard_normal((90, 32)) * 0.01])
    df = table(spark, v)
    flat = dedup.semantic_duplicates(df.unionByName(df.limit(1).selectExpr("CAST(NULL AS long) AS vec_id", "embedding")), block=50)
    want = {(a, b) for a, b in pairs(v, 0.92, 1) if a < b}
    got = [(r.a, r.b) for r in flat.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 4000
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and ("CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan)


def test_flat_search_at_a_lower_limit_writes_each_vector_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(dedup, "written", lambda df, name, write=dedup.written: made.append(write(df, name)) or made[-1])
    v = vectors(500)
    got = [(r.a, r.b) for r in dedup.semantic_duplicates(table(spark, v), least=0.6, block=40).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in pairs(v, 0.6, 1) if a < b}
    assert sum(len(r.k) // 8 for r in made[0].collect()) == len(v)
