"""Alignment of two tokenizers' tokens by a dangling-suffix transducer (operator 13).

The transducer reads both token sequences of a text. Its state is which side leads and the bytes by which it leads (the residual); the side that is
behind gives the next token, which overlaps the leader's last token. A step takes the token's bytes off the residual, or leaves the rest of
the token as the other side's residual. Transitions are kept by (residual, next token); an empty residual closes a group.

Neither tokenizer has a token across a space that follows a character other than white space, so residuals are empty there, and a text is the
sequence of the pieces between such spaces. A piece is tokenized and aligned once and kept, as words recur; the memory for pieces is bounded.

How many documents hold a pair linked is counted by chunks of text: a chunk sends each of its pairs once, with the number of its documents
that hold it, and gets back the corpus-wide counts of its own pairs. No count table is held whole anywhere.

Cases: null and empty texts, and those that one tokenizer can't give back byte by byte, have no tokens: zeros and an empty string; null ids and repeated
rows are documents like others; a text of any length is one document of its chunk; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _seq
from corpusmill.llm._spark import materialize

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# fixed value: what the byte-level pre-tokenizer splits by
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a space behind a character that is no white space: no token of either side goes across
PIECE = re.compile(r"(?<=\S) ")


def byte_table(vocabulary: dict[str, int]) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, in which every byte is one printable character: those that are not printable follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a space, <0xHH> a byte."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def byte_encoder(path: str):
    """The bytes of each id of a byte-level BPE vocabulary, and an encoder by it. Merges must be numbered in their order, behind the single bytes."""
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    table = byte_table(model["vocab"])
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if sorted(table[:256]) != [bytes([k]) for k in range(256)] or merged != list(range(256, 256 + len(merged))):
        raise ValueError(f"{path}: not a byte-level vocabulary with merges in the order of ids")
    ranks = {b: k for k, b in enumerate(table[: 256 + len(merged)])}
    return table, tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Transducer:
    """Aligns token sequences of two vocabularies; transitions are kept by state and next token."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = 1 << 20):
        self.bytes, self.width, self.most = (a, b), len(b), most
        self.number: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple[int, bytes]] = [(0, b"")]  # state 0: nothing dangles
        self.next: dict[int, int] = {}

    def state(self, leader: int, residual: bytes) -> int:
        """The number of a state; residuals are suffixes of tokens, so there are no more states than those."""
        if not residual:
            return 0
        key = leader, residual
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side's ``token``, -1 if bytes differ."""
        leader, residual = self.states[state]
        new = self.bytes[1 - leader][token]
        if residual.startswith(new):
            return self.state(leader, residual[len(new) :])
        return self.state(1 - leader, new[len(residual) :]) if new.startswith(residual) else -1

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Where groups end in ``a`` and ``b``, and the code of the linked ids, an entry for each pair of occurrences; None if bytes differ."""
        kept, width, states = self.next, self.width, self.states
        if len(kept) > self.most:
            kept.clear()
        ends, links = [], []
        i = j = state = x = y = 0
        n, m = len(a), len(b)
        while True:
            if not state:
                if i:
                    ends.append((i, j))
                if i == n:
                    return (ends, links) if j == m else None
                x, i = a[i], i + 1
                state = self.state(0, self.bytes[0][x])
                continue
            if states[state][0]:
                if i == n:
                    return None
                token = x = a[i]
                i += 1
            else:
                if j == m:
                    return None
                token = y = b[j]
                j += 1
            links.append(x * width + y)
            key = state << 20 | token
            state = kept.get(key, -2)
            if state < 0:
                state = kept[key] = self.step(key >> 20, token)
                if state < 0:
                    return None


#: what is kept of a piece: tokens of either side, groups (-1: bytes differ), codes of links as 32-bit numbers, and the groups as text
Aligned = tuple[int, int, int, bytes, str]


class Pieces:
    """Tokens, groups and links of pieces of text. What was asked for of late is kept: at most two generations of ``most`` pieces."""

    def __init__(self, byte_bpe: str, piece_bpe: str, most: int = 1 << 17):
        from sentencepiece import SentencePieceProcessor

        table, self.a = byte_encoder(byte_bpe)
        self.b = SentencePieceProcessor(model_file=piece_bpe)
        self.size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(self.size)]
        self.space = pieces.index("▁")
        self.digits = [str(k) for k in range(max(len(table), self.size))]
        self.transducer = Transducer(table, [piece_bytes(p) for p in pieces])
        self.most = most
        self.young: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}

    def all(self, pieces: list[str]) -> list[Aligned]:
        """What each piece, its space in front, is aligned to."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            young.update(zip(new, self._aligned(new), strict=True))
        return [young[p] for p in pieces]

    def _aligned(self, pieces: list[str]) -> Iterator[Aligned]:
        encode, align, digits = self.a.encode_ordinary, self.transducer.align, self.digits
        for p, y in zip(pieces, self.b.encode(pieces, num_threads=1), strict=True):
            x = encode(" " + p)
            y = y if p else [self.space]
            found = align(x, y)  # the first side always gives the bytes of the piece
            if found is None:
                yield 0, 0, -1, b"", ""
                continue
            ends, links = found
            text, i, j = [], 0, 0
            for k, m in ends:
                if k - i == 1 and m - j == 1:
                    text.append(f"{digits[x[i]]}|{digits[y[j]]}")
                else:
                    text.append(",".join([digits[t] for t in x[i:k]]) + "|" + ",".join([digits[t] for t in y[j:m]]))
                i, j = k, m
            yield len(x), len(y), len(ends), array("i", links).tobytes(), ";".join(text)

    def texts(self, texts: list[str | None]) -> Texts:
        """Sizes, distinct links and groups of each text."""
        split = [PIECE.split(t) if t else [] for t in texts]
        place = {p: k for k, p in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        found = self.all(list(place))
        off = np.append(0, np.cumsum([len(x) for x in split]))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(off[-1]))
        sizes = np.array([f[:3] for f in found], np.int64).reshape(-1, 3)
        n_links = np.array([len(f[3]) // 4 for f in found], np.int64)
        links = np.frombuffer(b"".join([f[3] for f in found]), np.int32)
        first = np.cumsum(n_links) - n_links
        doc = np.repeat(np.arange(len(texts)), np.diff(off))
        odd = np.zeros(len(texts), bool)
        odd[doc[sizes[at, 2] < 0]] = True
        ok = ~odd[doc]
        doc, used = doc[ok], at[ok]
        total = np.stack([np.bincount(doc, v, len(texts)).astype(np.int64) for v in (*sizes[used].T, n_links[used])], 1)
        size = n_links[used]
        take = np.arange(int(size.sum())) + np.repeat(first[used] - (np.cumsum(size) - size), size)
        pairs = np.sort(np.repeat(doc, size) << 32 | links[take])
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        start = np.flatnonzero(new)
        pairs, times = pairs[start], np.diff(np.append(start, len(pairs)))
        ids = at.tolist()
        groups = ["" if odd[k] or not split[k] else ";".join([found[i][4] for i in ids[off[k] : off[k + 1]]]) for k in range(len(texts))]
        return Texts(total, groups, np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)), (pairs & 0x7FFFFFFF).astype(np.int32), times.astype(np.int32))


class Texts(NamedTuple):
    """sizes: tokens of either side, groups and links of each text; pairs: the distinct links of each, sorted, from its ``off`` on; times: how often each."""

    sizes: np.ndarray
    groups: list[str]
    off: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _pieces(byte_bpe: str, piece_bpe: str) -> int:
    """The number of ids of the second vocabulary; a pair of ids is coded as first * this + second, in 32 bits."""
    tools = Pieces(byte_bpe, piece_bpe)
    if len(tools.transducer.bytes[0]) * tools.size >= 1 << 31:
        raise ValueError("pairs of ids of these vocabularies need more than 31 bits")
    return tools.size


def _chunks(df: DataFrame, key: str, text: str, byte_bpe: str, piece_bpe: str, chunk: int, digest: bool) -> DataFrame:
    """A row for each document, with its distinct links (as gaps between sorted codes) and how often each occurs; and a row
    without sizes for each chunk of about ``chunk`` bytes of text, with its distinct links (codes) and how many of its documents hold each."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<int>, times array<int>"
    names = ["key", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Pieces(byte_bpe, piece_bpe)
        part, no, held, own = TaskContext.get().partitionId(), 0, 0, []

        def close(key_type: pa.DataType) -> pa.RecordBatch:
            nonlocal no, held, own
            links, docs = np.unique(np.concatenate(own), return_counts=True)
            lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (links, docs)]
            row = [pa.nulls(1, key_type), pa.array([part << 32 | no]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *lists]
            no, held, own = no + 1, 0, []
            return pa.RecordBatch.from_arrays(row, names=names)

        for whole in batches:
            _, offs = _seq.buffers(whole.column(1))
            for lo, hi in _seq.cuts(offs, 1 << 22):
                b = whole.slice(lo, hi - lo)
                x = tools.texts(b.column(1).to_pylist())
                gaps = np.diff(x.pairs, prepend=np.int32(0)).astype(np.int32)
                begins = x.off[:-1][np.diff(x.off) > 0]
                gaps[begins] = x.pairs[begins]
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups] if digest else x.groups
                lists = [pa.ListArray.from_arrays(pa.array(x.off.astype(np.int32)), pa.array(v)) for v in (gaps, x.times)]
                cols = [b.column(0), pa.array(np.full(hi - lo, part << 32 | no)), *[pa.array(v) for v in x.sizes.T], pa.array(groups, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                if len(x.pairs):
                    own.append(x.pairs)
                held += int(offs[hi] - offs[lo])
                if held >= chunk and own:
                    yield close(b.column(0).type)
        if own:
            yield close(whole.column(0).type)

    return df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, schema)


def align_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, chunk: int = 32 << 20, digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    groups: the aligned groups as text ``a1,a2|b1;a3|b2,b3``, of which ``digest`` keeps the SHA-256. A link's count is how many documents hold its pair of ids
    linked; n_best counts links with the highest count of all pairs of their first id, count_sum adds all links' counts.
    """
    files = f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model"
    size = _pieces(*files)
    x = materialize(_chunks(df, key, text, *files, chunk, digest), "align-documents")
    held = x.where("n_a IS NULL").select("chunk", F.explode(F.arrays_zip("links", "times")).alias("p")).select("chunk", F.col("p.links").alias("pair"), F.col("p.times").alias("docs"))
    counts = materialize(held.groupBy("pair").agg(F.sum("docs").alias("n")), "align-counts")
    best = counts.groupBy(F.expr(f"pair div {size}").alias("a")).agg(F.max("n").alias("top"))
    named = counts.join(best, F.expr(f"pair div {size}") == F.col("a")).select("pair", F.when(F.col("n") == F.col("top"), F.col("n")).otherwise(-F.col("n")).alias("n"))
    asked = held.select("chunk", "pair").join(named.hint("merge"), "pair").select(F.col("chunk").alias("of"), "pair", "n")
    kind = x.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

    def counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
        """Counts of a chunk's own pairs, negative where they are not the highest of their first id, brought to its documents' links."""
        pair, n = (counts.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        lists = docs.column("links").combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        gap, times = (c.flatten().to_numpy().astype(np.int64) for c in (lists, docs.column("times").combine_chunks()))
        off -= off[0] if len(off) else 0
        codes = np.append(0, np.cumsum(gap))
        codes = codes[1:] - np.repeat(codes[off[:-1]], np.diff(off))
        found = n[np.searchsorted(pair, codes)] if len(pair) else np.zeros(0, np.int64)
        total = lambda v: np.diff(np.append(0, np.cumsum(v))[off])
        cols = [*[docs.column(c) for c in ("key", "n_a", "n_b", "n_groups", "n_links")], pa.array(total(times * (found > 0))), pa.array(total(times * np.abs(found))), docs.column("groups")]
        return pa.table(cols, names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return x.where("n_a IS NOT NULL").groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(counted, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return x.withColumnsRenamed({"key": "doc_id", "groups": "groups_sha256"})
