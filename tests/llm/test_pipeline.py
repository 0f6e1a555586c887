import collections
import re

import brute

import corpus_pipeline as P
from corpusmill.llm._spark import materialize


def test_stages_follow_the_rules(spark, folder):
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    cols = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(folder)), "test-stage")
        assert docs.columns == cols
        assert docs.where("_row <> 9 OR component <> 7 OR size <> 's' OR rank <> 8 OR family <> 10 OR q_words <> 12 OR q_kept OR _mix_row <> 13 OR _off_base <> 15 OR _pipeline_row <> 16 OR _hit_words <> 17 OR _metadata <> 'm' OR _more <> 18").count() == 0
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    first = seen["quality_rules"]
    assert all(len(re.findall(brute.SPACE, t)) >= 50 for _, t in first)

    def sets(t):
        w = brute.lower(t).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    close = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    kept = seen["near_dedup"]
    shingles = [sets(t) for _, t in kept]
    assert not any(close(shingles[i], shingles[j]) for i in range(len(kept)) for j in range(i))
    for i, t in first:
        assert any(i == k or close(sets(t), s) for (k, _), s in zip(kept, shingles, strict=True))
    from conftest import BENCHMARK

    clean = {r[0] for r in brute.op8(kept, BENCHMARK) if not r[5]}
    assert {i for i, _ in seen["decontamination"]} == clean
    times = collections.Counter()
    for i, t in seen["mixing"]:
        times[i] += len(t.split())
    size = {i: len(t.split()) for i, t in seen["decontamination"]}
    assert all(times[i] <= 3 * size[i] for i in times)
    assert abs(sum(times.values()) - sum(size.values())) <= 0.02 * sum(size.values()) + 3 * 32
    out = P.run(spark, str(folder)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in seen["mixing"])
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_keeps_each_mixed_text_with_its_place(spark):
    rows = [(i % 5, f"text {i % 5} pass {i}", "en", "a", 13, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more int")
    out = P.sharding(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.more) for r in out) == sorted(rows)
    assert len({(r.shard, r.slot) for r in out}) == len(rows)


def test_no_plan_holds_many_shuffles(spark, folder, monkeypatch):
    """The driver plans a query anew after each of its shuffles, and runs those that wait for none at once: its memory grows with their number."""
    from corpusmill.llm import _spark, jaccardjoin, mixing, simhash

    shuffles = {}

    def written(df, name):
        shuffles[name] = len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    for module in (_spark, jaccardjoin, mixing, simhash):
        monkeypatch.setattr(module, "materialize", written)
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    for stage in (P.near_dedup, P.mixing):
        written(stage(spark, docs, str(folder)), stage.__name__)
    assert {"jaccard-hubs", "near_dedup", "mix-slots", "mixing"} <= set(shuffles)
    assert max(shuffles.values()) <= 10, shuffles


def test_empty(spark, empty):
    assert P.run(spark, str(empty)).count() == 0
