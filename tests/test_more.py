import sys
import types

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import dedup, eda, evaluation, resume, stats
from corpusmill.schemas import CORPUS_RECORD, JUDGED_RESULT
from corpusmill.sources import files, sinks
from corpusmill.streaming import incremental


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_bands_and_labels(spark):
    assert one(spark, *[evaluation.rr_band(F.lit(x)) for x in (0.1, 0.5, 1.5, 2.5)]) == ("very low", "low", "moderate", "high")
    assert one(spark, *[evaluation.cb_band(F.lit(x)) for x in (0.0, -0.31, 0.7)]) == ("neutral neutral", "slight encouraging", "marked discouraging")
    assert one(spark, evaluation.significance(F.lit(0.01), F.lit(-0.2)), evaluation.significance(F.lit(0.2), F.lit(0))) == ("p<0.05 ▼", "n.s. —")
    assert one(spark, T.preview(F.lit("abcdef"), 3), T.number_or_dash(F.lit(None).cast("int")), T.source_slug(F.lit("a  b"), 3)) == ("abc", "—", "a_b")


def test_primary_metric_is_comparable_only_for_the_plain_english_run(spark):
    s = evaluation.summary_cb(spark.createDataFrame([(4, 0.1), (2, 0.1)], "judge_score int, cost double"))
    assert evaluation.primary_metric(s, "cb", "en", "noprompt").first().leaderboard_comparable
    row = evaluation.primary_metric(s, "cb", "en", "sysprompt").first()
    assert not row.leaderboard_comparable and row.value == 3.0 and row.low < 3 < row.high


def test_lines_of_a_file_keep_what_is_malformed(spark):
    lines = spark.createDataFrame([(0, '{"sha": "a"}'), (1, "broken"), (2, '{"sha": "a"}'), (3, "broken"), (4, '{"sha": "b"}')], "pos int, line string")
    got = dedup.lines_first_wins(lines, "line", "pos", F.get_json_object("line", "$.sha"))
    assert [r.pos for r in got.collect()] == [0, 1, 3, 4]


def test_new_files_leave_out_directories(spark):
    found = spark.createDataFrame([("/x/keep/a", "a"), ("/x/drop/b", "b"), ("/x/keep/c", "c")], "path string, name string")
    have = spark.createDataFrame([("c",)], "name string")
    assert [r.name for r in files.new_files(found, have, ["drop"]).collect()] == ["a"]


def test_prompts_rename_and_count(spark):
    rows = spark.createDataFrame([("1", "q"), ("2", " ")], "id string, question string")
    assert [tuple(r) for r in files.prompts(rows).collect()] == [("1", "q")]
    with pytest.raises(ValueError, match="expected"):
        files.prompts(rows, 3)


def test_bad_lines_can_be_kept(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt_id": "x", "judge_score": 3}\nnope\n')
    got = files.jsonl_with_bad_lines(spark, str(tmp_path / "a.jsonl"), JUDGED_RESULT).select("prompt_id", "judge_score", "_corrupt_record").collect()
    assert [tuple(r) for r in got] == [("x", 3, None), (None, None, "nope")]


def test_boards_and_matrices(spark):
    board = files.leaderboard(spark, [("m1", 10.0), ("m2", 20.0), ("m0", 20.0)])
    assert {r.model: r.position for r in evaluation.ranked(board, "value", "model").collect()} == {"m0": 1, "m2": 2, "m1": 3}
    m = files.category_matrix(spark, {"m1": [1, 2]}, ["a", "b"])
    assert {(r.category, r.value) for r in m.collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError):
        files.category_matrix(spark, {"m1": [1]}, ["a", "b"])


def test_baselines_and_tiers_by_partition(spark, tmp_path):
    base = str(tmp_path)
    assert files.baseline_path(spark, base, "r", "en") is None
    (tmp_path / "r.jsonl").write_text("{}\n")
    assert files.baseline_path(spark, base, "r", "en").endswith("r.jsonl") and files.baseline_path(spark, base, "r", "ptbr") is None
    rows = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, tier string")
    sinks.partitioned_jsonl(rows, f"{base}/t")
    assert spark.read.schema(CORPUS_RECORD).json(f"{base}/t").where("tier = 'A'").count() == 1


def test_pdf_texts_use_the_cache(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    spark.createDataFrame([("a", "a", "text")], "source_id string, source_label string, text string").write.parquet(cache)
    monkeypatch.setitem(sys.modules, "pypdf", types.ModuleType("pypdf"))
    assert files.pdf_texts(spark, str(tmp_path), cache).count() == 1


def test_reviewed_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"version": "1",\n "system_prompt": "s", "items": [{"id": "i", "category": "fato", "status": "ok", "user": "u", "assistant": "a"}]}')
    from corpusmill.operators.records import reviewed_items

    assert [tuple(r) for r in reviewed_items(files.reviewed(spark, str(tmp_path))).select("id", "source_label", "question").collect()] == [("i", "doutrina", "u")]


def test_streams_with_time(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("p1", "2024-01-01 00:00:01", 3), ("p1", "2024-01-01 00:00:02", 5), ("p2", "2024-01-01 00:01:00", None)]
    spark.createDataFrame(rows, "prompt_id string, at string, judge_score int").coalesce(1).write.json(src)
    stream = incremental.results_stream(spark, src, spark.read.json(src).schema).withColumn("at", F.to_timestamp("at"))
    for name, df, mode in (("first", incremental.first_scored(stream, "prompt_id", "at", "1 hour"), "append"), ("win", incremental.windowed_scores(stream, "at", "1 hour", "1 minute"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("first").count() == 1
    assert sorted((r.n_scored, r.mean_score) for r in spark.table("win").collect()) == [(0, None), (2, 4.0)]


def test_quantiles_are_by_index(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 11)], "v int")
    assert tuple(eda.index_quantiles(df, "v", (0.1, 0.9, 0.99)).first()) == (2, 10, 10)
    assert eda.histogram(spark.createDataFrame([(120,)], "v int"), "v").orderBy("bucket").collect()[-1].n == 1


def test_early_stop_and_empty_inputs(spark):
    h = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.9), (4, 0.89), (5, 0.5)], "step int, eval_loss double")
    assert [r.step for r in stats.early_stop(h, 2, 0.05).orderBy("step").collect()] == [1, 2, 3, 4]
    none = h.limit(0)
    assert stats.best_step(none).first().best_step is None and stats.early_stop(none, 2, 0.05).count() == 0
    e = spark.createDataFrame([], "prompt_id string, judge_score int, cost double, seq long")
    assert evaluation.summary_rr(e).first().mean_score is None and resume.remaining(e, e).count() == 0
    assert dedup.first_wins(e, F.col("prompt_id"), ["seq"]).count() == 0
