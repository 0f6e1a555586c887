"""The operators' own interfaces and the structures below them."""

import collections
import gzip
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import _repeats, _seq, _spark, decontamination, eliasfano, fingerprintlog, lmscore, mixing, sharding, simhash, substrings, suffixarray, warc


@pytest.mark.parametrize("letters", [2, 1024])
def test_suffix_arrays(monkeypatch, letters):
    monkeypatch.setattr(suffixarray, "LETTERS", letters)
    rng = random.Random(5)
    for _ in range(300):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 3, 5])
        s = [rng.randrange(1, k + 1) for _ in range(n)]
        s = (s[:3] * 20)[:n] if rng.random() < 0.3 else s
        full = [*s, 0]
        assert suffixarray.suffix_array(np.array(full, np.int16), k + 1).tolist() == sorted(range(len(full)), key=lambda i: full[i:])


def test_repeated_starts():
    rng = random.Random(6)
    for _ in range(200):
        parts = [bytes(rng.randrange(97, 97 + rng.choice([1, 2, 3])) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        parts += parts[:1] * rng.randrange(2)
        w = rng.choice([1, 3, 9])
        n = collections.Counter(p[i : i + w] for p in parts for i in range(len(p) - w + 1))
        got = suffixarray.repeated_starts([np.frombuffer(p, np.uint8) for p in parts], w)
        assert [g.tolist() for g in got] == [[i for i in range(len(p) - w + 1) if n[p[i : i + w]] > 1] for p in parts]


def test_segments_cover_all_windows_and_anchor_them_by_content():
    rng = random.Random(1)
    for _ in range(100):
        seqs = [[rng.randrange(1, 3) for _ in range(rng.randrange(40))] for _ in range(4)]
        off = np.cumsum([0] + [len(s) for s in seqs])
        g = _seq.segments(np.array([x for s in seqs for x in s], np.uint64) * np.uint64(0x9876543210FEDCB1), off, 8, 3)
        key, n = {}, 0
        for q, st, nw, k, inner in zip(g["seq"], g["start"], g["windows"], g["key"], g["inner"], strict=True):
            own = [tuple(seqs[q][st + j : st + j + 8]) for j in range(nw)]
            assert all(len(w) == 8 and key.setdefault(w, k) == k for w in own) and (inner or len(set(own)) == len(own))
            n += nw
        assert n == sum(max(0, len(s) - 7) for s in seqs)


def test_hot_anchors_take_the_other_way_to_the_same_result(spark, folder):
    df = spark.read.parquet(str(folder / "documents.parquet"))
    get = lambda **o: sorted((tuple(r) for r in substrings.repeated_bytes(df, **o).collect()), key=repr)
    assert get(hot=1) == get() == get(shard=500)


def test_fingerprint_log_counts_over_runs(spark, tmp_path):
    path, new = f"file://{tmp_path}/log", []
    for keys in ([1, 2, 2], [2, 3], [], [3, 4], [4, 5]):  # opened anew for each batch
        log = fingerprintlog.FingerprintLog(spark, path, fanout=3)
        new.append({r.key for r in log.append(spark.createDataFrame([(k, 1) for k in keys], "key long, n long")).collect()})
    assert new == [{2}, {2}, set(), {3}, {4}]
    again = fingerprintlog.FingerprintLog(spark, path)
    assert again.runs == log.runs and len(again.runs) < 3
    assert {r.key for r in again.known(spark.createDataFrame([(1,), (4,), (9,)], "key long")).collect()} == {1, 4}
    assert {r.key for r in again.repeated().collect()} == {2, 3, 4}
    assert fingerprintlog.FingerprintLog(spark, f"{path}-none").repeated().count() == 0


def test_fingerprint_log_skips_what_a_compaction_left_over(spark, tmp_path):
    log = fingerprintlog.FingerprintLog(spark, f"file://{tmp_path}/log", fanout=9)
    for keys in ([1], [1, 2]):
        log.append(spark.createDataFrame([(k, 1) for k in keys], "key long, n long"))
    both = log._read((0, 0)).unionByName(log._read((1, 1))).groupBy("key").agg(F.sum("n").alias("n"))
    log._write(both, (0, 1))  # the job ended before the two were deleted
    (tmp_path / "log" / "run-00000002-00000002").mkdir()  # and the next batch was not written whole
    again = fingerprintlog.FingerprintLog(spark, log.path)
    assert again.runs == [(0, 1)] and {r.key for r in again.repeated().collect()} == {1}
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["run-00000000-00000001"]


def test_more_batches_change_nothing(spark, folder):
    df = spark.read.parquet(str(folder / "documents.parquet"))
    get = lambda n: sorted((tuple(r) for r in fingerprintlog.repeated_words(df, batches=n).collect()), key=repr)
    assert get(1) == get(4)


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    materialize = _spark.materialize
    monkeypatch.setattr(_spark, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    stars = [(9, 1), (1, 5), (7, 1), (1, 9), (8, 2), (3, 3)]
    find = lambda edges: sorted(tuple(r) for r in _spark.components(spark.createDataFrame(edges, "a long, b long"), "t").collect())
    assert find(stars) == [(1, 1), (2, 2), (5, 1), (7, 1), (8, 2), (9, 1)]
    assert len(written) == 1
    chain = [(k, k + 1) for k in range(40)]
    assert find(chain) == [(k, 0) for k in range(41)]
    assert find(stars + [(9, 8)]) == [(k, 1) for k in (1, 2, 5, 7, 8, 9)]


def test_ball_hashing_finds_all_links_to_three_bits(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps)[:30]:
        for _ in range(3):
            x = f
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in _spark.components(simhash.links(simhash.may_link(nodes)), "t").collect()}
    group = {x: x for x in signed}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in signed:
        for b in signed:
            if (a % 2**64 ^ b % 2**64).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert all(got.get(x, x) == find(x) for x in signed) and len(got) > 30


def test_rows_keep_their_numbers_when_a_scan_is_planned_anew(spark, folder, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.read.parquet(str(folder / "documents.parquet")).select("doc_id", "text").repartition(3).write.parquet(path)
    read = lambda: _repeats.numbered(spark.read.parquet(path), "doc_id", "text")
    get = lambda x: sorted(map(tuple, x.select("row", "id", "text").collect()), key=repr)
    docs = read()
    before = get(docs)
    place = lambda: {r.doc_id: tuple(r._place) for r in _spark.with_place(spark.read.parquet(path), "_place", "t").where("doc_id <> 3").collect()}
    places = place()
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert get(docs) == get(read()) == before and len({r[0] for r in before}) == len(before)
        assert place() == places and len(set(places.values())) == len(places)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_near_documents_need_five_word_shingles(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(400)]
    other = [word() for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    mixed = list(base)
    rng.shuffle(mixed)
    rows = [(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(mixed)), (4, " ".join(other)), (5, " ".join(base)), (6, None), (7, ""), (8, "short")]
    got = dict(map(tuple, simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 6, 8: 8}


def _grouped(rows, spark):
    """Components of near_documents, and those of all pairs at a Jaccard similarity of 0.8 compared by brute force."""
    got = dict(map(tuple, simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return got, {i: find(i) for i in sets}


def test_near_documents_find_truncated_extended_and_edited_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(100, 300))]
        m = int(len(base) * rng.choice([0.18, 0.2, 0.22, 0.24]))
        k = rng.randrange(len(base))
        edited = list(base)
        for j in rng.sample(range(len(base)), max(1, len(base) // 50)):
            edited[j] = word()
        texts = [base, base + [word() for _ in range(m)], base[: len(base) - int(0.19 * len(base))], base[:k] + [word() for _ in range(m)] + base[k:], edited]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    got, want = _grouped(rows, spark)
    assert got == want
    assert sum(got[i] != i for i in got) > 50


def test_near_documents_are_found_by_their_fingerprints_and_verified(spark, monkeypatch):
    from corpusmill.llm import jaccardjoin

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, near = [(1000, "one"), (1001, "one two"), (1002, None)], {}
    for i in range(0, 60, 2):
        base = [word() for _ in range(1200)]
        edited = list(base)
        edited[rng.randrange(1200)] = word()
        rows += [(i, " ".join(base)), (i + 1, " ".join(edited))]
        a, b = (simhash.fingerprint(" ".join(x).encode(), 5) for x in (base, edited))
        near[i + 1] = i if (a ^ b).bit_count() <= 3 else i + 1
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccardjoin, "hub_pairs", lambda *_: none)  # the join's own rounds find nothing
    monkeypatch.setattr(jaccardjoin, "tile_pairs", lambda *_: none)
    got = dict(map(tuple, simhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert {i: got[i] for i in near} == near and sum(near[i] != i for i in near) > 10
    assert all(got[i] == i for i in [*range(0, 60, 2), 1000, 1001, 1002])


def test_near_documents_compare_the_pairs_behind_a_hub_that_fails(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(300)]
    other = list(base)
    rng.shuffle(other)
    moved = base[20:150] + base[:20] + base[150:]
    rows = [(1, " ".join(other)), (2, " ".join(base)), (3, " ".join(moved))]
    common = [word() for _ in range(170)]  # alike, but most pairs below the limit
    rows += [(10 + i, " ".join(common + [word() for _ in range(30)])) for i in range(40)]
    rows += [(60 + i, t + " " + word()) for i, (_, t) in enumerate(rows[20:30])]
    got, want = _grouped(rows, spark)
    assert got == want and got[3] == 2 and got[65] == rows[25][0]


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 16):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert set(a) == set(range(n)) and all((x == y) or y == n for x, y in zip(a, b, strict=True))
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.03


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 5).tolist() != mixing.permuted(np.arange(1000), 1000, 6).tolist()


def test_mixed_texts_hold_what_the_mix_takes(spark, folder):
    df = spark.read.parquet(str(folder / "documents.parquet"))
    out = mixing.mixed_texts(df)
    assert out.columns == df.columns
    rows, taken = mixing.mix(df)
    words = F.size(F.filter(F.split("text", _spark.SPACE), lambda w: w != ""))
    assert out.agg(F.sum(words)).first()[0] == taken.agg(F.sum(F.col("end") - F.col("first"))).first()[0]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 1000), (1000, 1200), (1000, 10**12), (3000, 3000)):
        v = np.unique(rng.integers(0, u, n)).astype(np.uint64)
        q = np.unique(np.concatenate([v, rng.integers(0, u, 500).astype(np.uint64)]))
        at = {int(x): i for i, x in enumerate(v)}
        assert eliasfano.EliasFano.of(v, u).find(q).tolist() == [at.get(int(x), -1) for x in q]


def test_trie_is_a_distribution_and_survives_mapping():
    counts = np.array([50, 30, 10, 5])
    one = lmscore.unigram(counts, 100, 4)
    grams = {2: (np.array([0 << 20 | 1, 1 << 20 | 0, 1 << 20 | 2]), np.array([20, 9, 3])), 3: (np.array([(0 << 20 | 1) << 20 | 0]), np.array([7]))}
    trie = eliasfano.Trie.mapped(*lmscore.build_words(counts, one, grams).dump())
    unknown = 10.0 ** lmscore.unigram(np.array([0]), 100, 4)[0]
    rare = (5 / 100) * (1 - (4 + 1) / 102)  # words that are not in the trie
    for context in ([], [1], [0, 1], [3, 1]):
        total = 0.0
        for w in (0, 1, 2, 3, -1):
            seq = np.array([*context, w])
            uni = np.array([one[x] if x >= 0 else np.log10(unknown + rare) for x in seq])
            total += 10.0 ** lmscore.text_log_prob(trie, seq, np.array([0]), uni)[-1]
        assert total == pytest.approx(1, abs=2e-3)


def test_archives_are_plain_gzip_and_false_magic_is_no_record(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"u{i}", rng.randbytes(rng.choice([0, 10, 5000, 30000])) + warc.MAGIC * rng.randrange(40)) for i in range(80)]
    rows += [(7, "u7", rows[7][2]), (None, None, None), (501, "y", b"z" * 20_000_000)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html binary"), path)
    n = sum(gzip.decompress(p.read_bytes()).count(warc.VERSION) for p in (tmp_path / "w").glob("part*"))
    assert n == len(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [(r.fields["X-Key"], r.fields["WARC-Type"], bytes(r.payload)) for r in warc.read_records(spark, path).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("" if i is None else str(i)): (h or b"") for i, _, h in rows}
    assert len(got) == len(rows) and all(b == want[k] for k, t, b in got if t == "response")
    assert {want[k] for k, t, _ in got if t == "response"} == set(want.values())


def _foreign(version, k, body, names=str, line="\r\n"):
    head = [f"{names('WARC-Type')}: response", f"{names('WARC-Record-ID')}:<urn:uuid:{k}>", f"{names('Content-Length')}:   {len(body)}", f"{names('WARC-Target-URI')}: http://x/", "\thttp-folded", f"X-Own: {k}"]
    return f"WARC/{version}{line}".encode() + line.join(head).encode() + (line * 2).encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("part", ["700", "20000", "100000000"])
def test_archives_of_other_writers_are_read_whole(spark, tmp_path, part):
    rng = random.Random(9)
    names = [str, str.lower, str.upper]
    bodies = [rng.randbytes(rng.choice([0, 50, 3000])) + b"WARC/1.0\r\n" * rng.randrange(3) for _ in range(60)]
    records = [_foreign(rng.choice(["1.0", "1.1", "0.18"]), k, b, rng.choice(names)) for k, b in enumerate(bodies)]
    one = b"".join(gzip.compress(r, mtime=0) for r in records[:40])
    two = gzip.compress(b"".join(records[40:50]), mtime=0) + b"".join(gzip.compress(r, mtime=0) for r in records[50:])
    for n, data in enumerate((one, two)):
        (tmp_path / f"{n}.txt").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        got = warc.read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((int(r.fields["X-Own"]), bytes(r.payload)) for r in got) == list(enumerate(bodies))
    assert all(r.fields["WARC-Target-URI"] == "http://x/ http-folded" and r.fields["WARC-Record-ID"] == f"<urn:uuid:{r.fields['X-Own']}>" for r in got)


def test_what_is_no_record_is_an_error(spark, tmp_path):
    good = gzip.compress(_foreign("1.0", 1, b"body"), mtime=0)
    bad = {"torn": good[:-12], "other": good + gzip.compress(b"not a record"), "only other": gzip.compress(b"no record at all"), "behind": good + b"left over", "short": gzip.compress(_foreign("1.0", 1, b"body")[:-6]), "nameless": gzip.compress(b"WARC/1.0\r\nno field\r\n\r\n")}
    for name, data in bad.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_bytes(data)
        with pytest.raises(Exception, match="record|member|field"):
            warc.read_records(spark, str(tmp_path / name)).collect()
    (tmp_path / "padded").mkdir()
    (tmp_path / "padded" / "a.txt").write_bytes(good + b"\0" * 512)
    assert warc.read_records(spark, str(tmp_path / "padded")).count() == 1


def test_records_have_a_date_and_ids_of_their_own(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "x")] * 6 + [(None, None, None)] * 2, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"), date="2024-02-29T12:00:00Z")
    got = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert len({r.fields["WARC-Record-ID"] for r in got}) == len(got) == 8
    assert {r.fields["WARC-Date"] for r in got} == {"2024-02-29T12:00:00Z"}


def test_batches_of_a_log_are_held_against_all_before(spark, docs, tmp_path):
    pairs = [(i, t) for i, t, *_ in docs if not t or len(t) < 100_000]
    rng = random.Random(3)
    rng.shuffle(pairs)
    parts, log = [pairs[::3], pairs[1::3], [], pairs[2::3]], str(tmp_path / "log")
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "doc_id long, text string").repartition(2)
        got = sorted(map(tuple, fingerprintlog.repeated_words(df, log=log).collect()), key=repr)
        before = [p for x in parts[:k] for p in x]
        # the same as one call over all so far, for this batch's rows
        want = sorted(brute.op7(before + part)[len(before) :], key=repr)
        assert got == want
    assert sum(r[2] for r in want) > 500


def test_benchmark_in_blocks(spark, folder):
    df = spark.read.parquet(str(folder / "documents.parquet"))
    bench = spark.read.parquet(str(folder / "benchmark.parquet"))
    cols = ["doc_id", "_hit_words", "_hit_starts", "_hit_ends", "_hit_items"]
    get = lambda **o: sorted(((*r[:4], sorted(r[4])) for r in decontamination.find_contamination(df, bench, **o).select(*cols).collect()), key=repr)
    assert get() == get(most_bytes=60)


def test_running_offsets(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i % 5) for i in range(200)], "k long, g string, v int")
    got = _spark.running_offset(df, ["g"], ["k"], F.col("v"), "off", 8).collect()
    for g in ("a", None):
        own = sorted((r.off, r.v) for r in got if r.g == g)
        ends = sorted(r.off + r.v for r in got if r.g == g)
        assert own[0][0] == 0 and ends[-1] == sum(r.v for r in got if r.g == g)
        assert all(x[0] + x[1] <= y[0] for x, y in zip([o for o in own if o[1]], [o for o in own if o[1]][1:], strict=False))


def test_verdict_ranges_merge():
    z = np.zeros(4, np.int64)
    t = _repeats.verdict_table(z, z, np.array([0, 2, 1, 7]), np.array([1, 4, 2, 8]))
    assert list(zip(t.column("lo").to_pylist(), t.column("hi").to_pylist(), strict=True)) == [(0, 4), (7, 8)]


def _thue_morse(n, a, b):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_thue_morse_words_and_texts_do_not_collide(spark):
    words = [_thue_morse(4096, "a", "b"), _thue_morse(4096, "b", "a"), _thue_morse(200, "a", "b"), _thue_morse(200, "b", "a")]
    buf, off = _seq.buffers(pa.array([" ".join(words)]))
    for which in (0, 1):
        assert len(set(_seq.Words(buf, off, _seq.NOT_SPACE).values(which).tolist())) == 4
    rng = random.Random(2)
    side = [f"x{rng.randrange(10**6)}" for _ in range(34)]
    two = [(k, " ".join([*side[:17], words[k], *side[17:]])) for k in (0, 1)]
    df = spark.createDataFrame(two, "doc_id long, text string")
    assert [r.n_removed for r in fingerprintlog.repeated_words(df).collect()] == [0, 0]
    texts = [(k, _thue_morse(6000, *("ab" if k % 2 else "ba"))) for k in range(2)] + [(2, _thue_morse(3000, "ab", "ba"))]
    got = {r.doc_id: r[1:] for r in substrings.repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = {r[0]: tuple(r[1:]) for r in brute.op1(texts)}
    assert got == want


def test_words_of_any_bytes_and_lengths():
    rng = random.Random(4)
    words = {bytes(rng.choice(b"ab\0\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 900]))) for _ in range(400)}
    words = sorted(words)
    buf, off = _seq.buffers(pa.array([b"  ".join(words), b"", b"\n".join(words[:5])], pa.binary()))
    w = _seq.Words(buf, off, _seq.NOT_SPACE)
    h = w.values(0)
    assert len(set(h.tolist())) == len(words) and h[: len(words)][:5].tolist() == h[len(words) :].tolist()
    data, first, end = w.joined()
    assert [data[a:b] for a, b in zip(first, end, strict=True)] == words + words[:5]
