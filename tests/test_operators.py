import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import normalize
from corpusmill.operators import chunking, curation, dedup, evaluation, parsers, records, responder, resume, sampling, stats
from corpusmill.sources import files, reports, sinks
from corpusmill.streaming import incremental


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", None, 1), ("a", 3, 2)], {("a", 3, 2)}),
        ([("a", 3, 1), ("a", None, 2)], {("a", 3, 1)}),
        ([("a", 3, 1), ("a", 4, 2)], {("a", 4, 2)}),
        ([("a", None, 1), ("a", None, 2)], {("a", None, 2)}),
        ([(None, 1, 1), (None, None, 2)], {(None, 1, 1), (None, None, 2)}),
        ([], set()),
    ],
)
def test_prefer_valid(spark, rows, want):
    df = spark.createDataFrame(rows, "prompt_id string, judge_score int, seq long")
    assert {(r.prompt_id, r.judge_score, r.seq) for r in dedup.prefer_valid(df).collect()} == want


def test_chunks_follow_a_plain_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(n)) for n in (0, 1, 5, 30, 31, 100, 101, 250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.chunks(df, "doc_id", "text", 30, 10, 3, 4).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t in enumerate(texts):
        out, at = [], 0
        while at < len(t):
            piece = t[at : at + 30].strip()
            out += [piece] if len(piece) > 3 else []
            if at + 30 >= len(t):
                break
            at += 20
        if len(out) > 4:
            out = [out[k] for k in sorted({round(k * (len(out) - 1) / 3) for k in range(4)})]
        assert got.get(i, []) == out


def test_split_is_a_disjoint_cover_and_repeats(spark):
    df = spark.createDataFrame([(i, "A" if i < 3 else "B" if i < 103 else None) for i in range(150)], "id int, tier string")
    a = {r.id: r.split for r in sampling.stratified_split(df, "tier", "id", 0.05).collect()}
    b = {r.id: r.split for r in sampling.stratified_split(df.repartition(7), "tier", "id", 0.05).collect()}
    assert a == b and len(a) == 150
    n = {t: sum(a[i] == "eval" for i in ids) for t, ids in (("A", range(3)), ("B", range(3, 103)), (None, range(103, 150)))}
    assert n == {"A": 1, "B": 5, None: 2}
    with pytest.raises(ValueError, match="fraction"):
        sampling.stratified_split(df, "tier", "id", 0.5)


def test_modal_sample_fills_up_and_template_is_blind(spark):
    df = spark.createDataFrame([(i, 4 if i < 90 else i % 3 + 1) for i in range(98)], "prompt_id int, judge_score int")
    s = sampling.modal_sample(df, "judge_score", "prompt_id", 50)
    assert s.count() == 50 and s.where("judge_score <> 4").count() == 8
    template, key = sampling.blind_template(s, 1, 7)
    assert "judge_score" not in template.columns and key.count() == 50


def test_budget_stops_before_the_row_that_exceeds_it(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (4, 0.0)], "seq int, cost double")
    assert [r.seq for r in resume.within_budget(df, "cost", "seq", 1.0).orderBy("seq").collect()] == [1, 2]


def test_legacy_results_fail(spark):
    df = spark.createDataFrame([("a", None, "old")], "prompt_id string, judge_rationale string, judge_reasoning string")
    with pytest.raises(Exception, match="old scale"):
        resume.reject_legacy(df).collect()


def test_comparability(spark):
    a = spark.createDataFrame([("j", 1024, "s1")], "judge_model string, judge_max_tokens int, served string")
    status = lambda b: resume.comparability(a, b).first().status
    assert status(a) == "comparable"
    assert status(a.withColumn("served", F.lit("s2"))) == "snapshot drift"
    assert status(a.withColumn("judge_max_tokens", F.lit(512))) == "incomparable"


@pytest.mark.parametrize(("k", "n", "low", "high"), [(7, 150, 0.0228, 0.0932), (143, 150, 0.9068, 0.9772), (0, 150, 0, 0.025), (1170, 1456, 0.7824, 0.8232), (76, 1456, 0.0419, 0.0648)])
def test_wilson(spark, k, n, low, high):
    w = spark.range(1).select(evaluation.wilson(F.lit(k), F.lit(n)).alias("w")).first().w
    assert (round(w.low, 4), round(w.high, 4)) == pytest.approx((low, high), abs=1.01e-4)


def test_mean_interval_of_none_and_one(spark):
    df = spark.createDataFrame([(2.0,)], "x double")
    assert tuple(df.agg(evaluation.mean_interval(F.col("x")).alias("m")).first().m) == (2.0, 0.0, 2.0, 2.0, 1)
    assert tuple(df.where("x > 9").agg(evaluation.mean_interval(F.col("x")).alias("m")).first().m) == (None, None, None, None, 0)


def kappa_by_matrix(pairs, levels):
    n = len(pairs)
    o = {(a, b): 0 for a in levels for b in levels}
    for p in pairs:
        o[p] += 1
    row = {a: sum(o[a, b] for b in levels) for a in levels}
    col = {b: sum(o[a, b] for a in levels) for b in levels}
    num = sum((a - b) ** 2 * o[a, b] for a in levels for b in levels)
    den = sum((a - b) ** 2 * row[a] * col[b] / n for a in levels for b in levels)
    return 1 - num / den if den else 1.0


def test_kappa_is_that_of_the_matrices(spark):
    rng = random.Random(3)
    for n in (1, 2, 30):
        pairs = [(rng.randrange(5), rng.randrange(5)) for _ in range(n)]
        got = stats.weighted_kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
        assert got.kappa == pytest.approx(kappa_by_matrix(pairs, range(5)))


def test_agreement_fails_off_the_scale_and_tells_degenerate(spark):
    df = spark.createDataFrame([(1, 1), (2, 2)], "a int, b int")
    assert stats.agreement(df, "a", "b", 1, 7).first().verdict == "near-perfect"
    assert stats.agreement(df.withColumn("a", F.lit(1)), "a", "b", 1, 7).first().verdict == "degenerate"
    with pytest.raises(Exception, match="off the scale"):
        stats.agreement(df, "a", "b", 0, 1).collect()


def test_signed_ranks_and_exact_p(spark):
    deltas = [1, -2, 3, 4, -5, 6, 0]
    got = stats.signed_ranks(spark.createDataFrame([(d,) for d in deltas], "delta int")).first()
    assert (got.n, got.r_plus, got.r_minus, got.tie_term) == (6, 14.0, 7.0, 0)
    signs = list(itertools.product((0, 1), repeat=6))
    want = 2 * sum(sum(r for r, s in zip(range(1, 7), x, strict=True) if s) <= 7 for x in signs) / len(signs)
    assert stats.wilcoxon(6, 14.0, 7.0, 0)["p"] == pytest.approx(want)
    tied = stats.signed_ranks(spark.createDataFrame([(d,) for d in (1, 1, -1, 2)], "delta int")).first()
    assert (tied.r_plus, tied.r_minus, tied.tie_term) == (8.0, 2.0, 24)
    assert stats.wilcoxon(0, 0, 0, 0)["p"] is None and 0 < stats.wilcoxon(100, 3000, 2050, 60)["p"] < 1


def test_category_bias_keeps_all_categories(spark):
    r = spark.createDataFrame([(1, "A", "B "), (5, "A", "B"), (2, "B", "A"), (None, "A", "B"), (1, "zzz", "A")], "judge_score int, religion_from string, religion_to string")
    dim = spark.createDataFrame([("A",), ("B",), ("C\nD",)], "category string")
    got = {x.category: (x.pos, x.neg, x.total, x.net, x.enc_mult) for x in evaluation.category_bias(r, dim).collect()}
    assert got == {"A": (100, 50, 150, 50, 1.33), "B": (50, 100, 150, -50, 0.67), "C D": (0, 0, 0, 0, 0.0)}


def test_prices_need_a_whole_prefix(spark):
    table = spark.createDataFrame([("m/a", 1.0), ("m/a-pro", 7.0), ("default", 2.0)], "key string, price double")
    usage = spark.createDataFrame([(1, "m/a", 10), (2, "m/a-pro-1", 10), (3, "m/ab", 10), (4, "m/a-pro", 1)], "row_id int, model string, total_tokens int")
    assert {r.row_id: r.cost for r in curation.prices(usage, table).collect()} == {1: 10.0, 2: 70.0, 3: 20.0, 4: 7.0}


def test_semantic_duplicates_across_blocks(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    vec = base + [[x * 3 + rng.gauss(0, 0.05) for x in v] for v in base[:10]] + [[0.0] * 8, None]
    df = spark.createDataFrame(list(enumerate(vec)), "vec_id long, embedding array<double>")
    got = {(r.a, r.b) for r in dedup.semantic_duplicates(df, block=7).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if cos(vec[i], vec[j]) >= 0.92}
    assert got == want and want


WSC = "Título\n\nPergunta 1. Qual é o fim?\n\nR. O fim é este.\n\nReferências: x\n\npergunta 2. minúscula\n\nR. não\n\nPergunta 3. Sem resposta\n"
WLC = "1. Primeira\npergunta?\n\nUma resposta longa.\n\nRef 1\n\n2. Curta?\n\nSim.\n\nx"
HC = "1. P um?\n\nParte a.\n\nParte dois continua\n\n2. P dois?\n\nResposta\n\nsegue\n\nDIA DO SENHOR 2\n\n"
WCF = "CAPÍTULO 1: Da Escritura\nintro\n1. " + "a " * 30 + "\n2. curto\nCapitulo 2 Sem artigos\n" + "texto " * 12 + "\nCAPÍTULO 3: Curto\nx"
DORT = "Capítulo 1\n\nDa eleição\nARTIGO 1\n" + "b " * 30 + "REJEIÇÃO 9 fora\nREJEIÇÃO 1\n" + "c " * 30
LCF = "CAPÍTULO 1\nDas Escrituras\n1. " + "d " * 30


def test_parsers(spark):
    df = spark.createDataFrame([("wsc", WSC), ("wlc", WLC), ("heidelberg", HC), ("wcf", WCF), ("dort", DORT), ("lcf", LCF)], "doc string, text string")
    got = {(r.source, r.answer) for r in parsers.parse_all(df).collect()}
    long = lambda c: " ".join(c * 30)
    assert got == {
        ("WSC_1", "O fim é este."),
        ("WLC_1", "Uma resposta longa."),
        ("Heidelberg_1", "Parte a."),
        ("Heidelberg_2", "Resposta segue"),
        ("WCF_1.1", long("a")),
        ("WCF_2", " ".join(["texto"] * 12)),
        ("Dort_1.1", long("b")),
        ("Dort_1.rej1", long("c")),
        ("LCF_1.1", long("d")),
    }
    q = {r.source: r.question for r in parsers.parse_all(df, ["wcf", "dort"]).collect()}
    assert q["WCF_1.1"].endswith("no Capítulo 1 (Da Escritura), artigo 1?") and "'Da eleição'" in q["Dort_1.1"]
    with pytest.raises(ValueError, match="unknown"):
        parsers.parse_all(df, ["nope"])


def test_records_have_content_ids(spark):
    rows = spark.createDataFrame([(1, " q ", "a", "S_1", "label", ["r"])], "pos int, question string, answer string, source string, source_label string, confessional_refs array<string>")
    build = lambda how: records.build_records(rows, "rec", "sys", "t", "pt", "C", "1.0", "auto", F.lit(95), how).first()
    r = build("content")
    assert r.id == "rec-" + r.sha256[:12] and r.messages[1].content == "q" and build("sequence").id == "rec-00001"


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    (tmp_path / "t.jsonl").write_text('{"id": "a", "tier": "C"}\n\nbroken\n{"id": "b", "tier": "B"}\n')
    from corpusmill.schemas import CORPUS_RECORD

    assert {r.id for r in files.jsonl(spark, path, CORPUS_RECORD).select("id").collect()} == {"a", "b"}
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.jsonl(spark, path, CORPUS_RECORD, strict=True).collect()
    assert files.tiers(spark, {"C": path, "A": str(tmp_path / "none.jsonl")}).count() == 2
    out = str(tmp_path / "out")
    sinks.overwrite_jsonl(spark.range(3), out)
    sinks.replace_jsonl(spark.read.json(out).where("id > 0"), out)
    sinks.append_jsonl(spark.range(5, 6), out)
    assert sorted(r.id for r in spark.read.json(out).collect()) == [1, 2, 5]
    assert sinks.file_digests(spark, out).where("name LIKE 'part%'").count() >= 1
    sinks.write_json(spark, {"a": "é"}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": "é"}


def test_texts_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff end")
    assert files.texts(spark, str(tmp_path), "*.md").first().text == "ok � end"
    assert normalize("x") is not None


def test_manifest_and_reports(spark):
    df = spark.createDataFrame([(i, "A" if i % 2 else "B") for i in range(100)], "id int, tier string")
    m = sinks.manifest(sampling.stratified_split(df, "tier", "id", 0.1), "tier", 0.1, 42, "1")
    assert m["total_records"] == 100 and m["eval"]["by_tier"] == {"A": 5, "B": 5}
    table = spark.createDataFrame([("<x>", None), ("a|b", 0.5)], "k string, v double")
    assert "&lt;x&gt;" in reports.page("T", {"s": table}) and "| a\\|b | 0.5000 |" in reports.markdown("T", {"s": table}) and "—" in reports.console("T", table)


def test_configs(tmp_path):
    (tmp_path / "c.yaml").write_text("# c\nmodel:\n  name: \"q\"\n  rank: 16 # r\nlr: 2e-4\nflag: true\n")
    assert files.experiment_config(str(tmp_path / "c.yaml")) == {"model": {"name": "q", "rank": 16}, "lr": 2e-4, "flag": True}
    (tmp_path / "s.json").write_text('{"template": "x"}')
    with pytest.raises(KeyError):
        files.scoring_config(str(tmp_path / "s.json"))
    with pytest.raises(FileNotFoundError):
        files.system_prompt(str(tmp_path / "none.txt"))


def test_responder_resumes_and_reports_failures(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "prompt_id string, prompt string")
    done = spark.createDataFrame([("a", 1), ("b", None)], "prompt_id string, judge_score int")
    assert {r.prompt_id for r in responder.resume(p, done).collect()} == {"b", "c"}

    def fails(_: str) -> str:
        raise OSError("down")

    assert all(r.reply is None and "down" in r.error for r in responder.respond(p, fails, attempts=2, wait=0).collect())


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n in range(2):
        sinks.append_jsonl(spark.createDataFrame([(f"p{n}", f"Rating: {n + 3}")], "prompt_id string, reply string"), src)
        q = incremental.append_available(incremental.scored(incremental.results_stream(spark, src, spark.read.json(src).schema)), out, cp)
        q.awaitTermination(60)
    assert sorted((r.prompt_id, r.judge_score) for r in spark.read.json(out).collect()) == [("p0", 3), ("p1", 4)]
