"""Ordered scans against plain loops, over runs that lie in several ranges."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ordered, records, resume, stats


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables would be one range otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def data(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else rng.randrange(-2, 9), rng.choice([None, 0.25, 0.5, 1.0, 2.0, rng.random()])) for k in range(n)]
    return rows, spark.createDataFrame(rng.sample(rows, n), "pos long, run string, cost long, loss double").repartition(5)


def runs(rows, by_run):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[1] if by_run else 0].append(r)
    return out.values()


@pytest.mark.parametrize("by", [None, ["run"]])
def test_totals_and_budgets(spark, by):
    rows, df = data(spark)
    want, kept = {}, {}
    for own in runs(rows, by):
        spent, over = 0, False
        for pos, _, cost, _ in own:
            spent += cost or 0
            over |= spent > 100
            want[pos] = spent
            if not over:
                kept[pos] = spent
    assert {r.pos: r.t for r in ordered.running_total(df, "cost", ["pos"], "t", by).collect()} == want
    got = ordered.within_budget(df, "cost", ["pos"], 100, by)
    assert got.columns == ["pos", "run", "cost", "loss", "spent"]
    assert {r.pos: r.spent for r in got.collect()} == kept and 10 < len(kept) < len(rows)


@pytest.mark.parametrize("by", [None, ["run"]])
def test_ranks(spark, by):
    rows, df = data(spark)
    want = {r[0]: k + 1 for own in runs(rows, by) for k, r in enumerate(own)}
    assert {r.pos: r.k for r in ordered.with_ranks(df, ["pos"], "k", by).collect()} == want
    want = {r[0]: len(own) - k for own in runs(rows, by) for k, r in enumerate(own)}
    assert {r.pos: r.k for r in ordered.with_ranks(df, ["pos"], "k", by, descending=True).collect()} == want


@pytest.mark.parametrize(("by", "patience"), [(None, 2), (None, 30), (None, 1000), (["run"], 12)])
def test_early_stop(spark, by, patience):
    rows, df = data(spark)
    want = {}
    for own in runs(rows, by):
        best, waited = None, 0
        for pos, _, _, loss in own:
            better = best is None or (loss is not None and loss < best - 0.01)
            waited = 0 if better else waited + 1
            want[pos] = (better, waited)
            best = loss if best is None else best if loss is None else min(best, loss)
            if waited >= patience:
                break
    assert {r.pos: (r.improved, r.waited) for r in ordered.early_stop(df, patience, 0.01, "loss", "pos", by).collect()} == want


@pytest.mark.parametrize("by", [None, ["run"]])
def test_false_discovery(spark, by):
    rows, df = data(spark)
    want = {}
    for own in runs(rows, by):
        p = sorted((r[3] / 4, r[0]) for r in own if r[3] is not None)
        least = 1.0
        want |= {r[0]: None for r in own if r[3] is None}
        for k in range(len(p), 0, -1):
            least = min(least, p[k - 1][0] * len(p) / k)
            want[p[k - 1][1]] = least
    got = {r.pos: (r.q, r.rejected) for r in ordered.false_discovery(df.withColumn("p", F.col("loss") / 4), "p", 0.3, by).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert got[k] == (None, None) if q is None else got[k] == (pytest.approx(q), q <= 0.3)


@pytest.mark.parametrize("by", [None, ["run"]])
def test_quantiles(spark, by):
    rows, df = data(spark)
    want = set()
    for own in runs(rows, by):
        v = sorted(r[3] for r in own if r[3] is not None)
        want.add((*((own[0][1],) if by else ()), *[v[min(int(len(v) * q), len(v) - 1)] for q in (0.0, 0.5, 0.9, 1.0)]))
    got = ordered.range_quantiles(df, "loss", (0.0, 0.5, 0.9, 1.0), by)
    assert got.columns[-4:] == ["p0", "p50", "p90", "p100"] and {tuple(r) for r in got.collect()} == want


def test_scans_without_a_run_have_no_task_for_all_rows(spark):
    _, df = data(spark)
    scans = [resume.within_budget(df, "cost", "pos", 100), stats.early_stop(df, 3, 0.1, "loss", "pos"), stats.false_discovery(df.withColumn("p", F.lit(0.5)), "p"), records.with_sequence_ids(df, ["run", "pos"], "r"), ordered.range_quantiles(df, "loss", (0.5,))]
    for x in scans:
        plan = x._jdf.queryExecution().toString()
        assert "rangepartitioning" not in plan  # ranges are written before
        window = [line for line in plan.split("\n") if "Window [" in line]
        assert all("_range" in line for line in window)


def test_ids_follow_the_order_with_nulls_first(spark):
    rows, df = data(spark)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    got = {r.pos: r.id for r in records.with_sequence_ids(df, ["run", "pos"], "r").collect()}
    assert got == {r[0]: f"r-{k + 1:05d}" for k, r in enumerate(order)}


def test_empty_and_clashing(spark):
    _, df = data(spark, 10)
    none = df.limit(0)
    assert ordered.within_budget(none, "cost", ["pos"], 5).count() == ordered.with_ranks(none, ["pos"], "k").count() == ordered.early_stop(none, 2, 0.1, "loss", "pos").count() == 0
    assert ordered.range_quantiles(none, "loss", (0.5,), ["run"]).count() == ordered.false_discovery(none, "loss").count() == 0
    with pytest.raises(ValueError, match="_range"):
        ordered.with_ranks(df.withColumn("_range", F.lit(1)), ["pos"], "k")
