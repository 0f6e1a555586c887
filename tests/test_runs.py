"""Runs that write: jobs that end at any step, batches that come twice, restarts, calls under a limit, files with sidecars."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import responder
from corpusmill.sources import files, versions
from corpusmill.streaming import keyed
from corpusmill.streaming.incremental import results_stream


class Ended(Exception):
    pass


@pytest.mark.parametrize("step", ["rows", "pointer", "rename", "after"])
def test_a_rewrite_that_ends_at_any_step_leaves_old_or_new_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    versions.publish(spark.range(5), path)

    def end(*_, **__):
        raise Ended

    rows = versions.current(spark, path).where("id < 3")
    with monkeypatch.context() as m:
        if step == "rows":
            rows = rows.where(F.when(F.col("id") == 2, F.raise_error(F.lit("ended")).cast("boolean")).otherwise(F.lit(True)))
        if step == "pointer":
            m.setattr(versions, "point", end)
        if step == "rename":
            m.setattr(versions, "rename", end)
        if step == "after":
            versions.publish(rows, path)
        else:
            with pytest.raises(Exception):  # noqa: B017  Spark's own where the write fails
                versions.publish(rows, path)
    left = 3 if step == "after" else 5
    assert versions.current(spark, path).count() == left
    reading = versions.current(spark, path)
    versions.publish(spark.range(9), path)
    assert reading.count() == left and versions.current(spark, path).count() == 9
    versions.clear(spark, path, keep=0)
    assert versions.current(spark, path).count() == 9
    assert len([p for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")]) == 2


def test_a_table_without_a_version(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.current(spark, str(tmp_path / "none"))
    versions.publish(spark.range(0), str(tmp_path / "t"), "parquet")
    assert versions.current(spark, str(tmp_path / "t")).count() == 0


def test_a_batch_sent_twice_and_a_task_that_fails_once_leave_each_row_once(spark, tmp_path):
    path, marks = str(tmp_path / "log"), tmp_path / "failed"

    def flaky(batches):
        for b in batches:
            yield b
        if not marks.exists():
            marks.touch()
            raise OSError("the first try of the task ends behind its last row")

    rows = spark.range(20, numPartitions=1)
    with pytest.raises(Exception, match="the first try"):  # a local session does not retry tasks: the batch comes again
        versions.append_batch(rows.mapInArrow(flaky, "id long"), path, 0)
    assert versions.batches(spark, path, rows.schema).count() == 0
    assert versions.append_batch(rows.mapInArrow(flaky, "id long"), path, 0)
    assert not versions.append_batch(rows, path, 0)
    assert versions.append_batch(spark.range(20, 30), path, 1)
    got = [tuple(r) for r in versions.batches(spark, path, rows.schema).collect()]
    assert sorted(got) == [(i, int(i >= 20)) for i in range(30)]


def test_of_two_writers_of_a_batch_one_adds_it(spark, tmp_path):
    path, added = str(tmp_path / "log"), []
    both = [threading.Thread(target=lambda k=k: added.append(versions.append_batch(spark.range(k, k + 5), path, 7))) for k in (0, 100)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(added) == [False, True] and versions.batches(spark, path, spark.range(1).schema).count() == 5


SCHEMA = "prompt_id string, judge_score int, seq long"


def test_keyed_state_goes_on_after_restarts(spark, tmp_path):
    parts = [
        [("a", None, 5), ("b", 3, 1), (None, 1, 2), ("c", None, 3)],
        [("a", 2, 4), ("b", None, 9), (None, None, 8)],
        [("a", 7, 0), ("c", None, 6), ("d", 1, 7)],
    ]
    src, log, check = (str(tmp_path / x) for x in ("src", "log", "check"))
    schema = spark.createDataFrame([], SCHEMA).schema
    seen = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).write.mode("append").json(src)
        keyed.keep_latest(results_stream(spark, src, schema), log, check).awaitTermination()
        every = [r for p in parts[: k + 1] for r in p]
        want = []
        for key in {r[0] for r in every if r[0]}:
            own = [r for r in every if r[0] == key]
            best = max(own, key=lambda r: (r[1] is not None, r[2]))
            want.append((*best, min(r[2] for r in own)))
        want += [(*r, r[2]) for r in every if r[0] is None]
        out = keyed.latest(spark.createDataFrame([], SCHEMA)).schema
        got = [tuple(r) for r in keyed.kept(spark, log, out).select("prompt_id", "judge_score", "seq", "pos").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        seen.append(versions.batches(spark, log, out).where(f"batch = {k}").count())
    assert seen == [4, 3, 3]  # a batch adds the keys it has, not all of the state
    left = keyed.resume_from(spark.createDataFrame([(x,) for x in "abcde"], "prompt_id string"), log, out)
    assert sorted(r.prompt_id for r in left.collect()) == ["c", "e"]


def calls(tmp_path):
    """A call that leaves a mark with its begin and end."""

    def call(prompt: str) -> str:
        began = time.time()
        time.sleep(0.2 if prompt.endswith("0") else 0.1)
        (tmp_path / f"{prompt}-{began}").write_text(str(time.time()))
        return json.dumps({"usage": {"cost": 3}, "prompt": prompt})

    return call


def test_calls_are_bounded_at_once_and_replies_keep_their_order(spark, tmp_path):
    x = spark.createDataFrame([(i, f"p{i}") for i in range(24)], "prompt_id long, prompt string")
    got = responder.respond(x, calls(tmp_path), lanes=1, at_once=4).collect()
    assert [json.loads(r.reply)["prompt"][1:] for r in got] == [r.prompt_id for r in got] and len(got) == 24
    spans = [(float(p.name.split("-")[1]), float(p.read_text())) for p in tmp_path.iterdir()]
    assert max(sum(a <= t < z for a, z in spans) for t, _ in spans) == 4


@pytest.mark.parametrize(("limit", "most", "want"), [(100, 3, 33), (100, 10, 31), (2, 3, 0), (1000, 3, 50)])
def test_no_call_is_made_past_the_limit(spark, tmp_path, limit, most, want):
    marks = tmp_path / "marks"
    marks.mkdir()
    x = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "prompt_id long, prompt string").repartition(3)
    cost = F.get_json_object("reply", "$.usage.cost")
    run = lambda: responder.respond_within(x, str(tmp_path / "log"), limit, most, cost, "prompt_id", wave=8, call=calls(marks), lanes=2, at_once=4)
    got = run().collect()
    assert sorted(int(r.prompt_id) for r in got) == list(range(want)) and sum(r.cost for r in got) <= limit
    assert run().count() == want and len(list(marks.glob("p*"))) == want  # nothing is asked twice


def test_sidecars(spark, tmp_path):
    for name, text, side in (("a", "kept", {"quality_score": 95}), ("b", "low", {"quality_score": 92.9}), ("c", "no score", {"other": 1}), ("d", "no sidecar", None), ("e", "torn", "{"), ("f", "é\n\nlong " * 9000, {"quality_score": 93})):
        (tmp_path / f"{name}.md").write_text(text)
        if side is not None:
            (tmp_path / f"{name}.json").write_text(side if isinstance(side, str) else json.dumps(side))
    got = {r.stem: (r.text, r.score) for r in files.sidecar_texts(spark, str(tmp_path), 93).collect()}
    assert got == {"a": ("kept", 95.0), "d": ("no sidecar", None), "f": ("é\n\nlong " * 9000, 93.0)}
    assert {r.stem for r in files.sidecar_texts(spark, str(tmp_path), 0).collect()} == set("abcdef")


def test_sidecars_in_a_bundle(spark, tmp_path):
    rows = [("t/1.txt", "kept"), ("s/1.json", '{"quality_score": 95}'), ("t/2.txt", "low"), ("s/2.json", '{"quality_score": 92.9}'), ("t/3.txt", "no sidecar"), ("t/4.txt", "torn"), ("s/4.json", "{"), ("t/5", "no suffix"), ("t/6.txt", "")]
    files.bundle(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "b"))
    got = {r.stem: (r.text, r.score) for r in files.sidecar_texts(spark, str(tmp_path / "b"), 93, suffix=".txt", bundled=True).collect()}
    assert got == {"1": ("kept", 95.0), "3": ("no sidecar", None), "6": ("", None)}


def test_sidecar_scan_writes_no_file_for_each_document(spark, tmp_path, monkeypatch):
    from corpusmill.plans import runs

    spark.createDataFrame([(i, f"text {i}\n") for i in range(60)] + [(7, "again"), (None, "no id"), (61, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(None, 0, 0), (9, None, 0), (13, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(runs, "scratch_path", lambda *_: str(tmp_path / "written"))
    got = sorted((r.doc_id is None, r.doc_id, r.score) for r in runs.sidecar_scan(spark, str(tmp_path)).collect())
    want = [(False, i, 100.0 if i % 3 == 0 else None) for i in [*range(60), 7] if i != 13 and (i % 3 or i % 2)] + [(True, None, None)]
    assert got == sorted(want)
    assert len(list((tmp_path / "written").rglob("part-*"))) < 30
