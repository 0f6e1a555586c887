"""Cases that the test tables do not hold: null keys, each run's own ends, isolated failures, lists in configurations."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import curation, evaluation, parsers, sampling, stats
from corpusmill.sources import files


def test_rows_with_a_null_key_stay_in_splits_and_samples(spark):
    rows = spark.createDataFrame([(None if i % 5 == 0 else f"k{i}", "a" if i % 2 else None) for i in range(20)], "key string, tier string")
    assert sampling.stratified_split(rows, "tier", "key", 0.1).count() == 20
    assert sampling.three_way_split(rows, ["tier"], "key").groupBy().agg(F.count("split")).first()[0] == 20
    assert sampling.fraction_sample(rows, ["tier"], "key", 1.0).count() == 20


def test_direction_means_hold_transitions_inside_the_group_and_follow_each_run(spark):
    rows = "prompt_id string, judge_score int, religion_from string, religion_to string"
    before = spark.createDataFrame([("1", 2, "P", "M"), ("2", 6, "X", "P"), ("3", 4, "P", "X"), ("4", None, "X", "P"), ("5", 7, "X", "P")], rows)
    after = spark.createDataFrame([("1", 4, "P", "X"), ("2", 5, "X", "P"), ("3", 1, "P", "X"), ("4", 3, "X", "P")], rows)
    got = evaluation.direction_means(before, after, ["P", "M"]).first()
    assert (got.into_before, got.into_after, got.out_of_before, got.out_of_after) == (4.0, 5.0, 3.0, 2.5)


def test_a_source_that_fails_leaves_the_others(spark, tmp_path, monkeypatch):
    def broken(docs):
        return docs.select(F.raise_error(F.lit("torn page")).cast("string").alias("doc"))

    monkeypatch.setitem(parsers.PARSERS, "wlc", broken)
    docs = spark.createDataFrame([("wsc", "Pergunta 1. Why?\n\nR. Because it is so."), ("wlc", "1. What?\n\nAn answer of some length.")], "doc string, text string")
    rows, counts, failures = parsers.parse_apart(docs, str(tmp_path / "out"), ["wsc", "wlc", "lcf"])
    assert [r.answer for r in rows.collect()] == ["Because it is so."]
    assert counts == {"wsc": 1, "lcf": 0} and list(failures) == ["wlc"]


def test_lists_in_configurations(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("name: x  # a run\nlora:\n  r: 16\n  target_modules:\n    - q_proj\n    - v_proj\n  betas: [0.9, 0.99]\ntags:\n- a\n- 2\nnone: ~\ntrain:\n  on: true\n")
    assert files.experiment_config(str(p)) == {"name": "x", "lora": {"r": 16, "target_modules": ["q_proj", "v_proj"], "betas": [0.9, 0.99]}, "tags": ["a", 2], "none": None, "train": {"on": True}}


def test_a_scoring_prompt_needs_no_scale(tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"template": "t", "input_variables": [], "output_format": {}}')
    assert files.scoring_config(str(p))["template"] == "t"
    p.write_text('{"template": "t", "input_variables": []}')
    with pytest.raises(KeyError):
        files.scoring_config(str(p))


def test_caps_in_order(spark):
    x = spark.createDataFrame([("b", 3), (None, 1), ("a", 2), ("b", 4)], "source string, pos long")
    assert sorted(r.pos for r in curation.first_sources(x, "source", "pos", 2).collect()) == [1, 2]
    o = spark.createDataFrame([(1, 5.0), (2, None), (3, 0.5), (4, 0.5)], "id long, price double")
    assert [r.id for r in curation.cheapest(o, "price", "id", 3).collect()] == [3, 4, 1]


def test_published_direction_disagreement(spark):
    counts = [[11, 2, 0, 1, 0, 0, 0], [0, 4, 1, 0, 0, 0, 0], [0, 1, 1, 0, 0, 0, 0], [4, 3, 3, 15, 0, 0, 0], [1, 0, 0, 0, 1, 1, 0], [0, 0, 0, 0, 0, 1, 0]]
    rows = [(j + 1, h + 1) for j, line in enumerate(counts) for h, n in enumerate(line) for _ in range(n)]
    got = stats.direction_disagreement(spark.createDataFrame(rows, "judge int, human int"), "judge", "human", 4).first()
    assert (got.n, got.n_off_by_two, got.n_direction) == (50, 9, 12)
