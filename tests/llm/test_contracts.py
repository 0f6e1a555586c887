"""Every query of the subpackage against a plain version, over odd texts; and over empty tables."""

import collections
import random
import re
import zlib
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import alignment, lmscore, registry, secrets
from corpusmill.llm._spark import scratch_dir

QUERIES = registry.queries()


def rows(df, cols=None):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


@pytest.fixture(scope="session")
def pairs(docs):
    return [(i, t) for i, t, *_ in docs]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, str(empty)).count() == 0


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_simhash", "op7_substrings"])
def test_equals_the_plain_version(spark, folder, pairs, name):
    want = getattr(brute, name.split("_")[0])(pairs)
    assert rows(QUERIES[name](spark, str(folder))) == sorted(want, key=repr)


def test_op8(spark, folder, pairs):
    from conftest import BENCHMARK

    assert rows(QUERIES["op8_decontamination"](spark, str(folder))) == sorted(brute.op8(pairs, BENCHMARK), key=repr)


def test_op3(spark, folder, pairs):
    got = QUERIES["op3_secrets"](spark, str(folder))
    want = brute.op3(pairs)
    assert rows(got, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]) == sorted((r[:5] for r in want), key=repr)
    full = []
    for (i, t), r in zip(pairs, want, strict=True):
        spans = sorted([(int(x.split(":")[1]), ("assign", "access", "hex").index(x.split(":")[0]), int(x.split(":")[2])) for x in filter(None, r[5].split(","))] + [(a, 3, z) for a, z in brute.entropy_spans(t)])
        full.append((i, ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{a}:{z}" for a, k, z in spans)))
    assert rows(got, ["doc_id", "spans"]) == sorted(full, key=repr)
    assert sum("entropy" in x for _, x in full) == 2


def test_op3_over_long_texts_of_any_shape(spark):
    rng = random.Random(3)
    n = 350_000
    texts = ["ab-" * n + "ab", "12-" * n + "12", "=_" * n, " ".join(f"{rng.getrandbits(72):018x}" for _ in range(50_000)), "".join(rng.choice("ABCdef0123+/xyzXYZ") for _ in range(3 * n)), "id=0123456789/Kx9+vQ2/zR7pLm4TnW8sYb3u"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    x = secrets.scan_secrets(df)
    got = {r[0]: r[1:] for r in x.select("doc_id", F.size("secret_base"), F.expr("transform(filter(secret_spans, s -> s.kind = 'entropy'), s -> struct(s.s, s.e))")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == sum(brute.op3([(i, t)])[0][1:4])
        if i != 4:
            assert [tuple(s) for s in got[i][1]] == brute.entropy_spans(t)
    assert len(got[4][1]) == 1


def test_op9(spark, folder, pairs, docs):
    got = QUERIES["op9_quality"](spark, str(folder))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, base) == sorted(brute.op9_base(pairs), key=repr)
    assert got.where("base_failed AND kept").count() == 0
    junk = {i for i, t in pairs if t and ("$$$" in t or t.count("|") > 50)}
    assert not junk & {r.doc_id for r in got.where("kept").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = db.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == sorted(want.select(*cols).fetchall(), key=repr)


def test_op4(spark, folder, docs):
    got = [tuple(r) for r in QUERIES["op4_mixing"](spark, str(folder)).collect()]
    size = collections.Counter()
    for _, t, _, s in docs:
        size[s] += len(re.findall(brute.SPACE, t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    total = sum(size.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ -= over or open_
    source = {(i, len(re.findall(brute.SPACE, t or ""))): s for i, t, _, s in docs}
    taken = collections.Counter()
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(((i, len(re.findall(brute.SPACE, t or ""))) for i, t, *_ in docs), key=repr)
    for i, n, whole, goal, took in got:
        s = source[i, n]
        assert whole == size[s] and goal == pytest.approx(target[s]) and 0 <= took <= 3 * n
        taken[s] += took
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.05, abs=3 * 32)
    assert sorted(got, key=repr) == sorted((tuple(r) for r in QUERIES["op4_mixing"](spark, str(folder)).collect()), key=repr)


def test_op5(spark, folder, pairs):
    got = QUERIES["op5_sharding"](spark, str(folder)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs), key=repr)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op6(spark, tmp_path):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>é</p>", "", None, "a" * 70000, "<p>é</p>", "a" * 70000, "b\r\n\r\nWARC/1.1\r\n\r\n"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(QUERIES["op6_warc"](spark, str(tmp_path))) == sorted(brute.op6([(i, h) for i, _, h in pages]), key=repr)


def test_op10(spark, folder, pairs):
    got = QUERIES["op10_lm_score"](spark, str(folder)).collect()
    want = sorted(brute.op10_base(pairs), key=repr)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert [x[5] for x in have] == pytest.approx([x[5] for x in want])
    assert all(r.score < 0 for r in got)


def test_op10_scores_are_those_of_the_plain_model(spark, folder, pairs):
    docs = spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = lmscore.score_texts(docs, held, share=2.0**-11, chunk=4000)
    have = sorted(((r.key, r.n_tokens, r.score) for r in got.collect()), key=repr)
    want = sorted(brute.op10_score(pairs, 2.0**-11), key=repr)
    assert len(have) == len(want) and sum(n for _, n, _ in want) > 10_000
    for (i, n, a), (j, m, b) in zip(have, want, strict=True):
        assert (i, n) == (j, m) and a == pytest.approx(b, abs=1e-9 + n * 4e-4)  # a level keeps log10 to 16 bits


def test_op10_takes_no_share_that_its_codes_cannot_hold(spark, folder):
    with pytest.raises(ValueError, match="share"):
        lmscore.score_texts(spark.read.parquet(str(folder / "documents.parquet")), F.lit(False), share=2.0**-21)


def test_op10_keeps_every_ngram_of_two_at_any_size(spark):
    """Over 2**21 training tokens a share of 2**-20 asks for three occurrences; a pair and a triple that occur twice count all the same."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(90_000)) for _ in range(24)]
    texts += ["one rare turn of phrase", "one rare turn of phrase", "the rare turn", "one rare turn of the phrase"]
    rows = [(i, t) for i, t in enumerate(texts)]
    train = [[*t.split(), None] for t in texts[:-1]]
    one = Counter(w for x in train for w in x)
    two = {g: n for g, n in Counter(g for x in train for g in zip(x, x[1:], strict=False)).items() if n > 1}
    three = {g: n for g, n in Counter(g for x in train for g in zip(x, x[1:], x[2:], strict=False)).items() if n > 1}
    total, once = sum(one.values()), sum(n == 1 for n in one.values())
    assert total > 1 << 21
    unknown = (once + 1) / (total + 2)
    left1, left2 = Counter(), Counter()
    for (a, _), n in two.items():
        left1[a] += (n - 0.75) / one[a]
    for (a, b, _), n in three.items():
        left2[a, b] += (n - 0.75) / two[a, b]
    p1 = lambda w: one[w] / total * (1 - unknown) if one[w] else unknown
    p2 = lambda a, b: (two.get((a, b), 0.75) - 0.75) / max(one[a], 1) + (1 - left1[a]) * p1(b)
    p3 = lambda a, b, c: (three.get((a, b, c), 0.75) - 0.75) / two[a, b] + (1 - left2[a, b]) * p2(b, c) if (a, b) in two else p2(b, c)
    got = {}
    for chunk in (1 << 20, 1 << 26):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got[chunk] = {r.key: r.score for r in lmscore.score_texts(df, F.col("doc_id") == len(rows) - 1, chunk=chunk).collect()}
        for i in range(len(texts) - 5, len(texts)):
            x = [*texts[i].split(), None]
            want = sum(math.log10(p1(w) if k == 0 else p2(x[0], w) if k == 1 else p3(x[k - 2], x[k - 1], w)) for k, w in enumerate(x))
            assert got[chunk][i] == pytest.approx(want, abs=1e-9 + len(x) * 4e-4)
    assert got[1 << 20] == pytest.approx(got[1 << 26], abs=1e-6)


def test_op10_writes_no_more_than_twice_its_input(spark, tmp_path):
    """Lists of n-grams with a hash or two an item took 3.6 times the input; texts and counts by numbers of words take about as much as it."""
    before = set(Path(scratch_dir(spark).removeprefix("file:")).iterdir())
    QUERIES["op10_lm_score"](spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "out"))
    made = set(Path(scratch_dir(spark).removeprefix("file:")).glob("lm-*")) - before
    size = sum(f.stat().st_size for d in made for f in d.rglob("*.parquet"))
    assert 0 < size < 2 * Path("/root/testdata/sf0.01/documents.parquet").stat().st_size


def test_op10_predicts_held_out_texts_better_than_the_base(spark, sf):
    held = [r for r in QUERIES["op10_lm_score"](spark, sf).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op12(spark, folder, docs):
    labels = [(i, i % 3 == 0, i % 2) for i in range(60)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    labels = [(i, None if q is None else int(q), t) for i, q, t in labels]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit("n")).write.parquet(str(folder / "labels.parquet"))
    got = QUERIES["op12_filter_audit"](spark, str(folder))
    want = brute.op12([(i, t, lang) for i, t, lang, _ in docs], labels)
    assert rows(got) == sorted(want, key=repr) and len(want) == 600 * 3


OP13 = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op13(spark, folder, pairs):
    assert rows(QUERIES["op13_alignment"](spark, str(folder)), OP13) == sorted(brute.op13(pairs), key=repr)


def test_op13_odd_texts_and_small_chunks(spark):
    rng = random.Random(5)
    part = ["a", "b", " ", " ", "  ", "\n", " \n", "\r\n", "\t", "é", "\u0301", "😀", "中文", "ﬁ", "▁", "<s>", "<|endoftext|>", "<0x41>", "'s", "don't", "x" * 30, "1234", "\x00", "\x1c", "...", "$"]
    texts = [None, "", " ", "  ", "\n", "▁"] + ["".join(rng.choice(part) for _ in range(rng.randrange(1, 40))) for _ in range(500)] + ["z" * 50_000, " " * 50_000, "\n " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(brute.op13(list(enumerate(texts))), key=repr)
    assert rows(alignment.align_tokens(df, digest=True, chunk=2000)) == want
    assert sum(r[1] > 0 for r in want) > 200 and sum(r[1] == 0 for r in want) > 20
    plain = {r.key: r.groups for r in alignment.align_tokens(df).collect()}
    assert all(brute.sha(plain[r[0]].encode()) == r[7] for r in want if r[1])
