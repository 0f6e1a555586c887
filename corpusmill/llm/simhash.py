"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 2).

Two fingerprints at 3 differing bits or fewer share a point that one reaches with one flip and the other with
two. Each distinct fingerprint emits all points at one flip or none. At an odd distance the two
differ in parity, so only those of even parity emit points at two flips; and two of any three bits lie in the same half,
so pairs of flips within a half suffice: 65 rows, and 992 more for half the fingerprints, in place of
2,081. What meets is at most 3 bits apart, by the triangle inequality, unless both sides made two flips. So a point links
its least fingerprint of at most one flip with all others there: links grow with rows, not with pairs, and a
point has at most 2,081 distinct fingerprints around it. Each link is verified by its bit count.

Before that, blocks of bits tell which fingerprints can link at all: 3 flips leave two of five blocks
equal, so a fingerprint emits its ten pairs of blocks, and one that shares no pair with another is out. The
filter drops no link.

``near_documents`` is for pipelines: it links texts by the similarity of their five-word shingles. The same search finds texts whose fingerprints of
those shingles are near, and each such pair is verified by its shingles. Fingerprints alone would miss
part of the texts near the limit, so the rounds of the exact join of operator 11 follow on what is still apart.

Cases: a null text is an empty one, with fingerprint zero; equal fingerprints are one node, however many
documents carry it; null ids are never a component's id, unless there is no other (then null); repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm._spark import components, materialize, numbered_rows
from corpusmill.llm.jaccardjoin import similar_rows


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42, batch: int = 1 << 16) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, batch):
        h = np.array([of(line[a:b], seed) for a, b in zip(first[k : k + batch], last[k : k + batch], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"key {kind}, fp long")


def _flip(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def may_link(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """The fingerprints that agree with another one, of the same ``family`` if there are families, in two of radius + 2 blocks of bits."""
    n = radius + 2
    edge = [64 * k // n for k in range(n + 1)]
    part = [F.call_function("shiftrightunsigned", F.col("fp"), F.lit(x)).bitwiseAND(F.lit((1 << (y - x)) - 1)) for x, y in zip(edge, edge[1:], strict=False)]
    family = F.col("family").cast("long") if "family" in nodes.columns else F.lit(0).cast("long")
    # one number: family, pair of blocks (6 bits), the blocks (16 bits each)
    which = [(i, j) for i in range(n) for j in range(i + 1, n)]
    pairs = [F.call_function("shiftleft", family * 64 + k, F.lit(32)).bitwiseOR(F.call_function("shiftleft", part[i], F.lit(16))).bitwiseOR(part[j]) for k, (i, j) in enumerate(which)]
    rows = nodes.select("fp", F.explode(F.array(*pairs)).alias("at"))
    met = rows.groupBy("at").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("at")
    some = rows.join(met, "at", "left_semi")
    if "family" in nodes.columns:
        return some.select(F.call_function("shiftright", "at", F.lit(38)).cast("int").alias("family"), "fp").distinct()
    return some.select("fp").distinct()


def links(nodes: DataFrame, radius: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Verified links (a, b), enough to connect all fingerprints (of equal ``by``) at ``radius`` bits or fewer; 2 or 3."""
    if radius not in (2, 3):
        raise ValueError("radius must be 2 or 3")
    one = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), _flip))
    rows = nodes.select(*by, "fp", F.lit(1).alias("flips"), F.explode(one).alias("m"))
    if radius == 3:
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: _flip(i).bitwiseOR(_flip(j)))))
        two = F.concat(pairs, F.transform(pairs, lambda m: F.call_function("shiftleft", m, F.lit(32))))
        rows = rows.unionByName(nodes.where(F.bit_count("fp") % 2 == 0).select(*by, "fp", F.lit(2).alias("flips"), F.explode(two).alias("m")))
    rows = rows.select(*by, "fp", "flips", F.col("fp").bitwiseXOR(F.col("m")).alias("at"))
    hub = F.min(F.when(F.col("flips") == 1, F.col("fp"))).over(Window.partitionBy(*by, "at"))
    met = rows.withColumn("hub", hub).where("hub <> fp").select(*by, F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _links_of(nodes: DataFrame) -> DataFrame:
    """Links of the fingerprints of ``nodes`` that can have any."""
    some = materialize(may_link(nodes.select("fp")), "simhash-candidates")
    return links(some.repartition(max(8, -(-some.count() // SPREAD)), "fp"))  # each becomes some hundreds of rows


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp, component): component is the smallest key among all rows that links lead to."""
    prints = materialize(fingerprints(df, key, text, shingle, seed), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("key").alias("key"))
    roots = components(_links_of(nodes), "simhash-links").select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("key").alias("component"))
    named = materialize(rooted.join(names, "root").select("fp", "component"), "simhash-components")
    return prints.join(named, "fp").select("key", "fp", "component")


#: fingerprints that one task turns into points
SPREAD = 4096


def near_prints(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Pairs (a, b) of rows: each with the first row of its fingerprint, and the first rows of fingerprints that link."""
    prints = materialize(fingerprints(docs, "row", text, shingle), "near-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("first")), "near-nodes")
    of = lambda c: nodes.select(F.col("fp").alias(f"f{c}"), F.col("first").alias(c))
    found = materialize(_links_of(nodes), "near-links")
    across = found.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of("a"), "fa").join(of("b"), "fb").select("a", "b")
    return prints.join(nodes, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")).unionByName(across)


def near_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, numbered: bool = False) -> DataFrame:
    """(key, component) of every row: the components of all pairs that share ``percent`` of their shingles (Jaccard), exactly.

    Pairs of near fingerprints are verified first, then follow the rounds of :mod:`corpusmill.llm.jaccardjoin`. Texts with the same set of shingles, the empty one too, are one. ``numbered``: the
    rows have numbers of their own, ``row``.
    """
    docs = df if numbered else numbered_rows(df.select(key, text), "near-rows")
    return similar_rows(docs, key, text, shingle, percent, apart=False, first=near_prints(docs, text, shingle)).select("key", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = near_duplicates(docs)
    return x.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
