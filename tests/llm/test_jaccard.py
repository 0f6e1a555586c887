"""The exact similarity join against all pairs, where links, limits and tiles are close."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import jaccardjoin


def rows(df):
    return sorted((tuple(r) for r in df.select("key", "n", "component").collect()), key=repr)


def family(rng, base, n, most):
    """Copies of a text with up to ``most`` words changed, put in or taken out."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 2])] = [f"v{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
        out.append(" ".join(w))
    return out


def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    out = []
    for size in (5, 7, 12, 40, 60, 150, 152):
        for most in (1, 3, 6):
            out += family(rng, rng.choices(words, k=size), 12, most)
    base = rng.choices(words, k=200)
    for _ in range(60):  # all just under the limit or just above
        k = rng.randrange(200)
        out.append(" ".join(base[:k] + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([12, 14, 20]))] + base[k:]))
    line = " ".join(rng.choices(words, k=30))
    out += [line + " " + " ".join(rng.choices(words, k=k % 20)) for k in range(60)]
    far = rng.choices(words, k=100)  # copies of a text: most of them link with each other, few with the first
    out += [" ".join(rng.choices(words, k=9) + far[9:])] + family(rng, far, 40, 4)
    # a chain: each links with the next only
    chain = rng.choices(words, k=120)
    for k in range(12):
        out.append(" ".join(chain[4 * k :] + [f"c{j}" for j in range(4 * k)]))
    return out + ["A b C d e", "a B c D e", "a", "A", "a b", "a b", "", None, " \n"]


@pytest.mark.parametrize(("shingle", "percent", "block"), [(4, 85, 1024), (4, 85, 8), (5, 80, 16), (1, 60, 32)])
def test_equals_all_pairs(spark, monkeypatch, shingle, percent, block):
    monkeypatch.setattr(jaccardjoin, "BLOCK", block)
    docs = list(enumerate(texts()))
    docs += [(None, docs[3][1]), docs[40], docs[40], (None, "quite another text of eight words it is")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = sorted(brute.op11(docs, shingle, percent), key=repr)
    assert rows(jaccardjoin.jaccard_components(df, shingle=shingle, percent=percent)) == want
    assert len({c for *_, c in want}) < len(want)


def test_op11_odd_tables(spark, folder, docs):
    from corpusmill.llm import registry

    got = registry.queries()["op11_jaccard_join"](spark, str(folder))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.op11([(i, t) for i, t, *_ in docs]), key=repr)


def test_pairs_of_tiles_are_those_of_all_rows():
    rng = np.random.default_rng(3)
    n = 400
    tile = np.sort(rng.integers(0, 9, n))
    t = pa.table({"at": tile, "tile": tile * 0, "first": tile * 0, "second": (tile % 2), "block": rng.integers(0, 2, n) * (tile % 2), "own": rng.integers(0, 2, n) > 0, "node": np.arange(n), "n": rng.integers(90, 110, n), "pos": rng.integers(0, 12, n), "comp": rng.choice([7, 7, 7, 8, 9, 10], n)})
    bits = rng.integers(0, 2**63, (n, jaccardjoin.WORDS)) & rng.integers(0, 2**63, (1, jaccardjoin.WORDS)) & rng.integers(0, 2, (n, jaccardjoin.WORDS)) * 15
    t = t.append_column("sketch", pa.array(bits.tolist()))
    got = sorted((a, b) for r in jaccardjoin._matches(t, 85, False, 500) for a, b in zip(*r.to_pydict().values(), strict=True))
    r = t.to_pylist()
    want = []
    for i in range(n):
        for j in range(i + 1, n):
            x, y = r[i], r[j]
            need = -(-85 * (x["n"] + y["n"]) // 185)
            ok = x["at"] == y["at"] and x["second"] == y["second"] and x["comp"] != y["comp"] and (x["own"] or y["own"]) and (x["second"] == 0 or x["block"] != y["block"])
            ok = ok and 100 * min(x["n"], y["n"]) >= 85 * max(x["n"], y["n"]) and all(z["pos"] <= z["n"] - need for z in (x, y))
            if ok and sum((p ^ q).bit_count() for p, q in zip(x["sketch"], y["sketch"], strict=True)) <= x["n"] + y["n"] - 2 * need:
                want.append((i, j))
    assert got == want and len(want) > 50
    near = [(a, b) for r in jaccardjoin._matches(t, 85, True, 500) for a, b in zip(*r.to_pydict().values(), strict=True)]
    assert set(near) <= set(want) and len(near) < len(want) and {(r[x]["at"], x) for p in near for x in p} <= {(r[x]["at"], x) for p in want for x in p}


def test_bitmaps_bound_the_difference_at_any_two_lengths(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(9000)]
    base = rng.sample(words, 9000)
    docs = [(k, " ".join(base[:n])) for k, n in enumerate((3, 60, 1000, 1030, 1200, 2040, 2060, 4000, 4200, 8100, 9000))]
    docs.append((99, " ".join(rng.sample(words, 4100))))
    df = spark.createDataFrame(docs, "row long, text string").withColumn("key", jaccardjoin.F.col("row")).coalesce(1)
    t = jaccardjoin.signatures(df, "key", "text", 1, 85, jaccardjoin.common_shingles(df, "text", 1)).toArrow().sort_by("row")
    bits = jaccardjoin.Bitmaps(t.column("sketch").combine_chunks())
    assert set(bits.words) == {16, 32, 64, 128, 256}
    i, j = (x.ravel() for x in np.meshgrid(range(len(docs)), range(len(docs))))
    sets = [set(x.split()) for _, x in docs]
    real = np.array([len(sets[a] ^ sets[b]) for a, b in zip(i, j, strict=True)])
    found = bits.differ(i, bits, j, 40)
    assert (found <= real).all() and ((real - found) % 2 == 0).all() and found[(i == 10) & (j == 9)] > 800
    assert not jaccardjoin.may_link(np.array([4100]), np.array([4000]), bits.differ(np.array([11]), bits, np.array([7])), 85)[0]
