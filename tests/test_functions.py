import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.functions import replies as R
from corpusmill.functions import text as T


def each(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(3)
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_round_is_pythons(spark):
    rng = random.Random(2)
    xs = [rng.randrange(0, 2000) / rng.choice([1, 2, 4, 8, 16, 20, 40, 200]) for _ in range(3000)] + [2.675, 0.125, 0.5, 1.5, 2.5, 12.35, 12.25, 1.005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", *[T.half_even(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2, 4)]).collect():
        for d in (0, 1, 2, 4):
            assert r[f"d{d}"] == round(r.x, d), (r.x, d)


SPACES = ["  a b ", "\x1c a b\x85", "", "\t\n", "é  ü\n\n", "\xa0x\xa0", "a\n"]


def test_white_space_is_pythons(spark):
    assert each(spark, SPACES, T.strip) == [s.strip() for s in SPACES]
    assert each(spark, SPACES, T.clean) == [re.sub(r"\s+", " ", s).strip() for s in SPACES]
    assert each(spark, SPACES, T.word_count) == [len(s.split()) for s in SPACES]


def test_mojibake_is_repaired_and_nothing_else(spark):
    assert each(spark, ["Ã©", "é", "abc", "Ã©€", "aÃ§Ã£o", "\xc3", "日本"], T.fix_mojibake) == ["é", "é", "abc", "Ã©€", "ação", "\xc3", "日本"]


def test_normalize(spark):
    raw = ["a\n  \n\nb", "a\r\nb\rc\x0bd\x85e f", "x\n\n\n\n\ny  \n \t \nz\n", "\n", "", "  ", "a\n\n"]
    want = [re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.strip() else "" for x in t.splitlines())) for t in raw]
    assert each(spark, raw, T.normalize) == want


def test_split_keep_drops_the_preamble(spark):
    assert each(spark, ["pre A1 x a2 y", "none"], lambda c: T.split_keep(c, r"(?i)a\d")) == [["A1 x ", "a2 y"], []]


def test_template_is_filled_once(spark):
    t = T.substitute("x {a} {b} {a}", {"a": F.lit("{b}"), "b": F.lit("2")}, ["a", "b"])
    assert spark.range(1).select(t).first()[0] == "x {b} 2 {b}"
    with pytest.raises(KeyError):
        T.substitute("{a}", {}, ["a"])


def test_quotes(spark):
    assert each(spark, ['"a"', "'a'", '"a', "a", '""', '"', ' "x y" ', "\"a'"], T.strip_quotes) == ["a", "a", '"a', "a", "", '"', "x y", "\"a'"]


def test_ratings(spark):
    raw = ["Rating: 4", "some reasoning\nRating: 6", "Rating: 8", "", "<think>Rating: 1</think>Rating: 2", "Rating: 4 \nx", "Rating:5", "xRating: 3", None]
    assert each(spark, raw, R.cb_score) == [4, 6, None, None, 2, 4, 5, None, None]


def test_json_scores(spark):
    raw = ['{"rationale": "ok", "score": 3}', '{"score": 9}', "not json at all", '```json\n{"score": "2"}\n```', '{"score": 3.7}', '{"score": true}', '{"score": [1]}', '{"score": "3.7"}', ""]
    got = each(spark, raw, R.rr_score)
    assert [g.score for g in got] == [3, None, None, 2, 3, 1, None, None, None]
    assert got[0].rationale == "ok" and got[1].reason.startswith("[out-of-range:9]") and got[2].reason.startswith("[parse-error]")


def test_rubric_and_pairs(spark):
    good = '```json\n{"precisao_teologica": 95, "clareza_pastoral": 90.5, "qualidade_ptbr": "96", "sem_alucinacao": 100}\n```'
    assert [(r.score, r.accepted) for r in each(spark, [good, "zz", "{bad}"], R.rubric_score)] == [(95.3, True), (0.0, False), (0.0, False)]
    pairs = each(spark, ['x [{"question": "q", "answer": "a"}, {"question": "only"}]', "none"], R.qa_pairs)
    assert [[tuple(p) for p in r] for r in pairs] == [[("q", "a")], []]


def test_label_keys(spark):
    assert [tuple(x) for x in each(spark, [" 3 ", "S", "quit", "9", "x", "+2"], lambda c: R.label_key(c, 0, 4))] == [("score", 3), ("skip", None), ("quit", None), ("bad", None), ("bad", None), ("score", 2)]


def test_content_hash_is_that_of_canonical_json(spark):
    m = [{"role": "system", "content": 's\x1f\x0b"\\u001F é\n\\'}, {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    want = hashlib.sha256(json.dumps({"messages": m, "tradition": "t", "lang": "l"}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    df = spark.createDataFrame([(m, "t", "l", 1), (m, "t", "l", 2)], "m array<struct<role:string,content:string>>, t string, l string, other int")
    assert {r[0] for r in df.select(H.content_hash("m", "t", "l")).collect()} == {want}
    assert tuple(df.select(H.first_user("m"), H.last_assistant("m"), H.spoken_text("m")).first()) == ("q", "a", "q a")


def test_missing_roles_are_empty(spark):
    df = spark.createDataFrame([([],)], "m array<struct<role:string,content:string>>")
    assert tuple(df.select(H.first_user("m"), H.last_assistant("m"), H.spoken_text("m")).first()) == ("", "", "")


def test_display(spark):
    got = spark.range(1).select(T.percent(F.lit(0.1234)), T.percent(F.lit(None).cast("double")), T.escape_html(F.lit('<a href="&">')), T.script_json(F.lit("</script>&")), T.slug(F.lit("m/a-b"))).first()
    assert tuple(got) == ("12.3%", "—", "&lt;a href=&quot;&amp;&quot;&gt;", "\\u003c/script\\u003e\\u0026", "m_a_b")
