"""Finding repeated windows of sequences across a corpus; operators 1 and 7 finish it each by its method.

A sequence is the bytes, or the words, of a text. Windows that are equal have equal anchors (see
``_seq.segments``), so only segments whose anchor occurs twice matter. Of these, equal segments are
one group: all its windows repeat. Where an anchor has several different segments, or recurs within
one, one segment of each group is fetched from its text and its windows are compared with the others'.

Anchors are hashed by a fast rolling polynomial, which only brings windows together. What counts as equal is decided by
XXH3 over all bytes: segments of one anchor by 64 bits, windows by 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import _seq
from corpusmill.llm._spark import bit, bitmap, marked, materialize, numbered_rows, pieces

SEGMENT = "row long, start int, windows int, key long, content long, inner boolean"


@dataclass(frozen=True)
class Kind:
    """What the sequences are: bytes, or words without the ASCII spaces."""

    words: bool
    window: int
    gram: int

    def segments(self, buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """The segments of texts laid end to end, with ``content``, a hash of all their bytes."""
        if self.words:
            w = _seq.Words(buf, off, _seq.NOT_SPACE)
            s = _seq.segments(w.values(0), w.off, self.window, self.gram)
            data, first, end = w.joined()
            content = _seq.strong64(data, first[s["first"]], end[s["end"] - 1]) if len(first) else np.zeros(0, np.int64)
        else:
            s = _seq.segments(_seq.BYTE[0][buf], off, self.window, self.gram)
            content = _seq.strong64(buf.tobytes(), s["first"], s["end"])
        return s | {"content": content}

    def windows(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of 128 bits of the windows of one text that start at the items ``at``."""
        if self.words:
            data, first, end = _seq.Words(buf, np.array([0, len(buf)]), _seq.NOT_SPACE).joined()
            return _seq.strong(data, first[at], end[at + self.window - 1])
        return _seq.strong(buf.tobytes(), at, at + self.window)


def segments_of(docs: DataFrame, kind: Kind, most: int = 1 << 20) -> DataFrame:
    """Segments of all texts of ``docs(row, text)``, see SEGMENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_numpy()
            data, offs = _seq.buffers(b.column(1))
            for a, z in _seq.cuts(offs, most):
                s = kind.segments(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
                cols = [rows[a:z][s["seq"]], s["start"].astype(np.int32), s["windows"].astype(np.int32), s["key"].view(np.int64), s["content"], s["inner"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "start", "windows", "key", "content", "inner"])

    return docs.select("row", "text").mapInArrow(run, SEGMENT)


def candidates(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """The segments whose anchor is in ``keys(key)``, written once."""
    return materialize(segments.join(keys.select("key").hint("merge"), "key", "left_semi"), "repeat-candidates")


def groups(cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, open): runs of windows known to repeat, and one segment of each group that must be compared.

    verdicts: key, content, lo, hi (windows of the segment, half open). open: key, content, row, start, windows, weight (bytes or
    words of all the segments of its anchor).
    """
    g = cand.groupBy("key", "content").agg(F.count("*").alias("n"), F.max("inner").alias("inner"), F.min(F.struct("row", "start", "windows")).alias("rep"))
    g = materialize(g, "repeat-groups")
    per_key = materialize(g.groupBy("key").agg(F.count("*").alias("kinds"), F.max("inner").alias("any_inner"), F.sum("rep.windows").alias("weight")).where("kinds > 1 OR any_inner").drop("any_inner", "kinds"), "repeat-keys")
    verdicts = g.where("n > 1").select("key", "content", F.lit(0).alias("lo"), F.col("rep.windows").alias("hi"))
    return verdicts, g.join(per_key.hint("merge"), "key").select("key", "content", "rep.row", "rep.start", "rep.windows", "weight", (F.col("n") == 1).alias("single"))


def chunk_of(row: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(n)).cast("int")


def number_of_chunks(docs: DataFrame) -> int:
    return pieces(docs, 4)


def window_rows(kind: Kind, part: pa.Table, data: np.ndarray, offs: np.ndarray, place: dict[int, int]) -> dict[str, np.ndarray]:
    """Hashes of all windows of the segments in ``part``: arrays key, content, off, single, a, b (two halves of 128 bits)."""
    out: dict[str, list] = {k: [] for k in ("key", "content", "off", "single", "a", "b")}
    key, content, single = part.column("key").to_numpy(), part.column("content").to_numpy(), part.column("single").to_numpy(zero_copy_only=False)
    row, start, windows = part.column("row").to_numpy(), part.column("start").to_numpy().astype(np.int64), part.column("windows").to_numpy().astype(np.int64)
    order = np.argsort(row, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else ():
        d = place[int(row[own[0]])]
        n = windows[own]
        at = np.repeat(start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = kind.windows(data[offs[d] : offs[d + 1]], at)
        out["a"].append(h[:, 0])
        out["b"].append(h[:, 1])
        out["off"].append((at - np.repeat(start[own], n)).astype(np.int32))
        for name, v in (("key", key), ("content", content), ("single", single)):
            out[name].append(np.repeat(v[own], n))
    return {k: np.concatenate(v) if v else np.zeros(0, bool if k == "single" else np.int64) for k, v in out.items()}


COMPARE = "shard int, key long, content long, lo int, hi int, a long, b long, many boolean, member boolean, text binary"


def compare_rows(cols: dict[str, np.ndarray], shards: int) -> pa.Table:
    """Window rows for :data:`COMPARE`, with equal windows of this chunk folded into one row.

    A window that is there once goes to the shard of its hash as a member. Of several, one row tells the shard that
    there are many, and the members, decided, go as runs of windows to shards of their own; so no shard gets more
    rows of one window than there are chunks.
    """
    n = len(cols["a"])
    order = np.lexsort((cols["b"], cols["a"]))
    a, b = cols["a"][order], cols["b"][order]
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    many = np.repeat(size > 1, size)
    asked = np.concatenate([order[~many], order[first[size > 1]]]).astype(np.int64)
    alone = np.arange(len(asked)) < (~many).sum()
    decided = order[many]
    decided = decided[cols["single"][decided]].astype(np.int64)
    runs = verdict_table(cols["key"][decided], cols["content"][decided], cols["off"][decided], cols["off"][decided] + 1)
    key, content, lo, hi = (c.to_numpy() for c in runs.columns)
    none = np.zeros(len(key), np.int64)
    own = _seq.mix(content.view(np.uint64) ^ (lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    shard = np.concatenate([cols["a"][asked].view(np.uint64), own]) % np.uint64(shards)
    at = cols["off"][asked].astype(np.int32)
    return pa.table(
        {
            "shard": pa.array(shard.astype(np.int32)),
            "key": np.concatenate([cols["key"][asked], key]),
            "content": np.concatenate([cols["content"][asked], content]),
            "lo": pa.array(np.concatenate([at, lo])),
            "hi": pa.array(np.concatenate([at + 1, hi]).astype(np.int32)),
            "a": np.concatenate([cols["a"][asked], none]),
            "b": np.concatenate([cols["b"][asked], none]),
            "many": pa.array(np.concatenate([~alone, none == 0])),
            "member": pa.array(np.concatenate([alone & cols["single"][asked], none == 0])),
            "text": pa.nulls(len(shard), pa.binary()),
        }
    )


def decided_windows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The members, among the window rows of a shard, that repeat: key, content, lo, hi."""
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    many, member = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("many", "member"))
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    weight = np.bincount(group, np.where(many, 2, 1)) if len(a) else np.zeros(0)
    hit = member & (many | (weight[group] > 1)) if len(a) else member
    return tuple(t.column(c).to_numpy()[hit] for c in ("key", "content", "lo", "hi"))


VERDICT = "key long, content long, lo int, hi int"


def verdict_table(key: np.ndarray, content: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """Ranges of windows, those that touch made one; they do not overlap."""
    order = np.lexsort((lo, content, key))
    k, c, a, z = key[order], content[order], lo[order], hi[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (a[1:] > z[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1 if len(k) else first
    return pa.table({"key": pa.array(k[first], pa.int64()), "content": pa.array(c[first], pa.int64()), "lo": pa.array(a[first].astype(np.int32)), "hi": pa.array(z[last].astype(np.int32))})


def finish(docs: DataFrame, cand: DataFrame, verdicts: DataFrame, kind: Kind, chunks: int, out: str, build: Callable) -> DataFrame:
    """Bring verdicts back to the texts: ``build(text, starts, ends)`` gives the columns of ``out`` after the key, for every row.

    starts and ends are the maximal runs of items that repeated windows cover.
    """
    spans = cand.join(verdicts.hint("merge"), ["key", "content"]).select(chunk_of(F.col("row"), chunks).alias("chunk"), "row", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + kind.window).alias("hi"))
    names = [c.split()[0] for c in out.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.column("row").to_numpy()
        order = np.argsort(row, kind="stable")
        row, lo, hi = row[order], right.column("lo").to_numpy()[order].astype(np.int64), right.column("hi").to_numpy()[order].astype(np.int64)
        ids = left.column("row").to_numpy()
        a, b = np.searchsorted(row, ids, "left"), np.searchsorted(row, ids, "right")
        got = [build(t.as_py() or b"", *_seq.union(lo[x:y], hi[x:y])) for t, x, y in zip(left.column("text"), a, b, strict=True)]
        cols = list(zip(*got, strict=True)) if got else [()] * (len(names) - 1)
        return pa.Table.from_arrays([left.column("id"), *[pa.array(c, pa.string() if isinstance((c or [0])[0], str) else pa.int64()) for c in cols]], names=names)

    # only texts with spans are shuffled; the others are read where they are
    shared = bitmap(spans, "row")
    kinds = {n: pa.string() if t == "string" else pa.int64() for n, t in (c.split() for c in out.split(", ")[1:])}
    none = np.zeros(0, np.int64)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~marked(shared.value, b.column(2).to_numpy())))
            cols = list(zip(*[build(t.as_py() or b"", none, none) for t in b.column(1)], strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)]], names=names)

    with_spans = chunked(docs, chunks, shared).groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(run, out)
    return with_spans.unionByName(docs.select("id", "text", bit("row")).mapInArrow(plain, out))


def fetch(docs: DataFrame, asked: DataFrame, chunks: int, run: Callable) -> DataFrame:
    """``run`` over the texts of the rows asked for, in chunks, with what is asked of them; other texts are not shuffled."""
    asked = asked.withColumn("chunk", chunk_of(F.col("row"), chunks))
    return chunked(docs, chunks, bitmap(asked, "row")).groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(run, COMPARE)


def chunked(docs: DataFrame, chunks: int, shared: Broadcast) -> DataFrame:
    """The rows of ``docs`` that are in the bitmap, with their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1, 2]).filter(pa.array(marked(shared.value, b.column(3).to_numpy())))

    kind = docs.schema["id"].dataType.simpleString()
    some = docs.select("row", "id", "text", bit("row")).mapInArrow(run, f"row long, id {kind}, text binary")
    return some.select(chunk_of(F.col("row"), chunks).alias("chunk"), "row", "id", "text")


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, text): every row of ``df`` with a number that stays its own in every job."""
    return numbered_rows(df.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")), "repeat-input").select("row", "id", "text")


def texts_of(left: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    data, offs = _seq.buffers(left.column("text"))
    return data, offs, {int(r): i for i, r in enumerate(left.column("row").to_numpy())}


def rows_where(t: pa.Table, mask: np.ndarray) -> pa.Table:
    return t.filter(pa.array(mask))


def binary_at(data: np.ndarray, offs: np.ndarray, d: int, a: int, b: int) -> bytes:
    return data[offs[d] + a : offs[d] + b].tobytes()


def is_null(t: pa.Table, col: str) -> np.ndarray:
    return pc.is_null(t.column(col)).to_numpy(zero_copy_only=False)
