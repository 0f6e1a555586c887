"""Language-model scores from an Elias-Fano n-gram trie (operator 10).

The model is a trigram model of words. Word counts of all training documents are exact; words outside of them count as
one unknown word, whose probability is that of the words seen once. Bigrams and trigrams
discount counts by ``DISCOUNT`` and back off; all three are proper distributions. Every bigram and trigram that occurs twice or more in the training
documents is in the model, at any size of corpus; those seen once are left out at any size. With a ``share``, only those that make up so much of all tokens are.

The model is never in one place. Documents fall into chunks of about ``CHUNK`` bytes, each of which is written once, as places in its list of words. The lists are
dealt into parts by a hash of the word; a part sums up the counts of all chunks and numbers its words, those of high counts first. Then a chunk lists its distinct
bigrams, each with the trigrams that go on from it, by the numbers of their words, in order: that takes few bytes and cannot mistake one word for another. These lists are
dealt into parts by the bigram's hash. A part sums up the counts of all chunks and what the kept trigrams take from each bigram, answers in the order it was asked,
and tells the words' parts what the kept bigrams take from each word. So a chunk has all that its tokens can ask for: from that it builds its own part of the
trie, whose levels are Elias-Fano sequences (see ``eliasfano``), memory-mapped, with 16-bit probabilities in steps that are the same in all chunks, and scores its documents.

Cases: a null text is an empty one and has its end as only token; a null id counts as the empty string in choosing
held-out rows; repeated rows train and score as often as they occur; an empty table gives no rows; with no training rows
every word is unknown; very long texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.llm._seq import mix
from corpusmill.llm._spark import materialize
from corpusmill.llm.eliasfano import Trie

SHARE = 2.0**-20
CHUNK = 8 << 20
PIECE = 1 << 20
WORDS = 1 << 18  # distinct words of chunks for each part that words are dealt into
BLOCK = 1 << 18  # tokens scored at a time
DISCOUNT = 0.75
END = b"\xff"  # not in UTF-8: the end of a text


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split() + [END]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with the number of their chunk; chunks follow each other within a partition."""
    part, no, held = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = pc.binary_length(b.column(1)).to_pylist()
        a = 0
        for i, s in enumerate(sizes):
            held += s or 0
            if held >= most:
                yield (part << 24) | no, b.slice(a, i + 1 - a)
                a, held, no = i + 1, 0, no + 1
        if a < len(sizes):
            yield (part << 24) | no, b.slice(a)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in one compressed frame, their bytes by place: the upper ones are mostly zeros."""
    raw = np.array([len(a) for a in arrays], np.int64).tobytes()
    raw += b"".join(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _raw(x: pa.BinaryScalar) -> pa.Buffer:
    b = x.as_buffer()
    return pa.Codec("zstd").decompress(b.slice(8), int.from_bytes(b.slice(0, 8).to_pybytes(), "little"))


def unpacked(x: pa.BinaryScalar, arrays: int) -> list[np.ndarray]:
    raw = _raw(x)
    at, out = 8 * arrays, []
    for n in np.frombuffer(raw, np.int64, arrays).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel())
        at += 8 * n
    return out


def joined(lists: list[list[np.ndarray]], arrays: int) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *(x[k] for x in lists)]) for k in range(arrays)]


def _packed_words(words: list[bytes]) -> bytes:
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _words(x: pa.BinaryScalar) -> list[bytes]:
    return _raw(x).to_pybytes().split()


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of items by part, otherwise as they are, and where each part ends."""
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))


def in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of numbers from 0, and which are, in that order, unlike the one before."""
    span = int(b.max(initial=0)) + 1
    order = np.argsort(a * span + b) if (int(a.max(initial=0)) + 1) * span < 1 << 63 else np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, new


def _encoded(most: int, kind: pa.DataType):
    """A row for each chunk: keys; texts as sizes, what is held out, and places in the list of words; that list and its training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held, own = None, [], [], []
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__

        def out() -> pa.RecordBatch:
            out_of, size = np.array(held, bool), np.fromiter(map(len, own), np.int64, len(own))
            token = np.concatenate(own)
            n = np.bincount(token, np.repeat(~out_of, size), len(place)).astype(np.int64)
            key = pa.concat_arrays(keys).cast(kind)
            cols = {"chunk": pa.array([now], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key)}
            cols |= {"texts": pa.array([packed(size, out_of, token)], pa.binary()), "words": pa.array([_packed_words(list(place))], pa.binary())}
            cols |= {"n": pa.array([packed(n)], pa.binary()), "train": pa.array([int(n.sum())], pa.int64()), "listed": pa.array([len(n)], pa.int64())}
            return pa.RecordBatch.from_pydict(cols)

        for chunk, b in _chunks(batches, most):
            if chunk != now and now is not None:
                yield out()
                for x in (keys, held, own, place):
                    x.clear()
            now = chunk
            keys.append(b.column(0))
            held += b.column(2).to_pylist()
            for t in b.column(1):
                words = tokens(t.as_py())
                own.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        if now is not None:
            yield out()

    return run


def _listed(parts: int):
    """What a chunk asks of each part that words are dealt into: words, and their places and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, w, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words, (n,) = _words(w), unpacked(n, 1)
                order, ends = by_part(np.fromiter(map(crc32, words), np.int64, len(words)) % parts, parts)
                some = np.flatnonzero(np.diff(ends, prepend=0))
                own = [order[ends[p - 1] if p else 0 : ends[p]] for p in some]
                cols = [pa.array([_packed_words([words[k] for k in i]) for i in own], pa.binary()), pa.array([packed(i, n[i]) for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array(some, pa.int64()), *cols], names=["chunk", "part", "words", "n"])

    return run


def _numbered(least: float, parts: int):
    """Places, numbers and counts of words to each chunk, and in a row of chunk -1 how many words are in training texts, and how many of them once.

    A word's number tells its part by its remainder; words that are too rare have none (-1)."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        lists = [unpacked(x, 2) for x in t.column("n")]
        words = pa.array(chain.from_iterable(map(_words, t.column("words"))), pa.large_binary()).dictionary_encode()
        code = words.indices.to_numpy()
        place, n = joined(lists, 2)
        count = np.bincount(code, n, len(words.dictionary)).astype(np.int64)
        number = np.full(len(count), -1, np.int64)
        often = np.flatnonzero(count >= least)
        number[often[np.argsort(-count[often], kind="stable")]] = np.arange(len(often)) * parts + part
        ends = np.cumsum([0] + [len(x) for x, _ in lists])
        answer = [packed(place[a:z], number[code[a:z]], count[code[a:z]]) for a, z in zip(ends, ends[1:], strict=False)]
        stats = [pa.array([0] * len(lists) + [int(k)], pa.int64()) for k in (np.count_nonzero(count), np.count_nonzero(count == 1))]
        cols = [pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()), pa.array([part] * (len(lists) + 1), pa.int64()), pa.array([*answer, None], pa.binary()), *stats]
        return pa.Table.from_arrays(cols, names=["chunk", "part", "answer", "kinds", "once"])

    return run


class Grams:
    """The distinct bigrams and trigrams of a chunk's tokens, none with a word that is too rare, and the order in which parts are asked for them.

    Tokens are places in the chunk's list of words; ``number`` has the words' numbers, ascending but for those that n-grams are not made of, which are -1.
    """

    def __init__(self, token: np.ndarray, size: np.ndarray, train: np.ndarray, number: np.ndarray, parts: int):
        a, often = token.astype(np.int64), number >= 0
        inside = np.ones(max(len(a) - 1, 0), bool)
        inside[np.cumsum(size)[:-1] - 1] = False
        inside &= often[a[:-1]] & often[a[1:]]
        at = np.flatnonzero(inside)
        train = np.repeat(train, size)
        self.two, which = np.unique((a[at] << 32) | a[at + 1], return_inverse=True)
        self.n_two = np.bincount(which, train[at], len(self.two)).astype(np.int64)
        bigram = np.full(len(a), -1, np.int64)
        bigram[at] = which
        at = at[bigram[np.minimum(at + 1, len(a) - 1)] >= 0]
        self.three, which = np.unique((bigram[at] << 32) | a[at + 2 if len(at) else at], return_inverse=True)
        self.n_three = np.bincount(which, train[at], len(self.three)).astype(np.int64)
        self.context = self.three >> 32
        self.first, self.second, self.third = number[self.two >> 32], number[self.two & 0xFFFFFFFF], number[self.three & 0xFFFFFFFF]
        key = mix(self.first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(self.second.view(np.uint64)))
        part = (key % np.uint64(parts)).astype(np.int64)
        self.order_two, self.ends_two = by_part(part, parts)
        self.order_three, self.ends_three = by_part(part[self.context], parts)

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """Of each part: bigrams by their first words (as steps), second words, counts and how many trigrams go on from them; third words and counts of these."""
        follow = np.bincount(self.context, minlength=len(self.two))
        for p in np.flatnonzero(np.diff(self.ends_two, prepend=0)):
            i = self.order_two[self.ends_two[p - 1] if p else 0 : self.ends_two[p]]
            j = self.order_three[self.ends_three[p - 1] if p else 0 : self.ends_three[p]]
            yield int(p), packed(np.diff(self.first[i], prepend=0), self.second[i], self.n_two[i], follow[i], self.third[j], self.n_three[j])


def _chunk(texts: pa.BinaryScalar, answers: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """A chunk's sizes, held-out texts and tokens, and its words' numbers and whatever else the answers hold; places follow the numbers, rare words come last."""
    size, held, token = unpacked(texts, 3)
    place, *known = joined(answers, len(answers[0]))
    number = np.zeros(len(place), np.int64)
    number[place] = known[0]
    order = np.argsort(np.where(number < 0, np.iinfo(np.int64).max, number), kind="stable")
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out = np.zeros((len(known), len(place)), np.int64)
    for o, x in zip(out, known, strict=True):
        o[rank[place]] = x
    return size, held.astype(bool), rank[token], *out


def _asked(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size, held, token, number, _ = _chunk(left.column("texts")[0], [unpacked(x, 3) for x in right.column("answer")])
        rows = list(Grams(token, size, ~held, number, parts).asked())
        chunk = left.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "part": pa.array([p for p, _ in rows], pa.int64()), "asked": pa.array([x for _, x in rows], pa.binary())})

    return run


def _summed(least: float, parts: int):
    """Answers of a part to each chunk, and in rows of chunk -1 what kept bigrams take from their first words, for each part that words are dealt into."""

    def run(t: pa.Table) -> pa.Table:
        lists = [unpacked(x, 6) for x in t.column("asked")]
        for x in lists:
            x[0] = np.cumsum(x[0])
        ends_two, ends_three = (np.cumsum([0] + [len(x[k]) for x in lists]) for k in (0, 4))
        first, second, n, follow, third, m = joined(lists, 6)
        del lists
        order, new = in_order(first, second)
        which = np.zeros(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = first[order[new]]
        two = len(first)
        total = np.bincount(which, n, two).astype(np.int64)
        context = np.repeat(which, follow)
        order, new = in_order(context, third)
        three = np.add.reduceat(m[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
        three[three < least] = 0
        of = context[order[new]]
        took, kinds = (np.bincount(of, x, two).astype(np.int64) for x in (three, three > 0))
        back = np.zeros(len(order), np.int64)
        back[order] = three[np.cumsum(new) - 1]
        total[total < least] = 0
        answer = [packed(*(x[which[a:z]] for x in (total, took, kinds)), back[b:y]) for a, z, b, y in zip(ends_two, ends_two[1:], ends_three, ends_three[1:], strict=False)]
        kept = np.flatnonzero(total)
        words, word = np.unique(first[kept], return_inverse=True)
        sums = [words // parts, *(np.bincount(word, x, len(words)).astype(np.int64) for x in (total[kept], np.ones(len(kept))))]
        order, ends = by_part(words % parts, parts)
        told = np.flatnonzero(np.diff(ends, prepend=0))
        answer += [packed(*(x[i] for x in sums)) for i in (order[ends[p - 1] if p else 0 : ends[p]] for p in told)]
        part = t.column("part")[0].as_py()
        cols = [[*t.column("chunk").to_pylist(), *[-1] * len(told)], [*[part] * t.num_rows, *told.tolist()]]
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(answer, pa.binary())], names=["chunk", "part", "answer"])

    return run


def _taken(parts: int):
    """Of a part of words, to each chunk: places, numbers, counts, and the sum and number of the counts of kept bigrams that begin with each word."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [unpacked(x, 3) for x in left.column("answer")]
        rank, took, kinds = joined([unpacked(x, 3) for x in right.column("answer")], 3)
        most = max((int(x.max(initial=0)) // parts for _, x, _ in asked), default=0) + 1
        sums = [np.append(np.bincount(rank, x, most).astype(np.int64), 0) for x in (took, kinds)]
        answer = [packed(*x, *(s[np.where(x[1] < 0, most, x[1] // parts)] for s in sums)) for x in asked]
        return pa.Table.from_arrays([left.column("chunk"), pa.array([-1] * len(asked), pa.int64()), pa.array(answer, pa.binary())], names=["chunk", "part", "answer"])

    return run


def unigram(count: np.ndarray, total: int, once: int) -> np.ndarray:
    """log10 probability of words with these counts; those of count 0 are all the unknown word (Good and Turing's estimate)."""
    unknown = (once + 1) / (total + 2)
    return np.log10(np.where(count > 0, count / max(total, 1) * (1 - unknown), unknown))


def build_trie(log_one: np.ndarray, orders: list[tuple[np.ndarray, ...]]) -> Trie:
    """Trie of a chunk's words and its kept bigrams and trigrams, with absolute discounting and backoff.

    ``orders``: for words, bigrams and trigrams the parent's place in the order before, the last word, the count, and the sum and number of the counts that
    kept n-grams one word longer have in the whole corpus; (parent, word) ascending.
    """
    trie = Trie(max(len(log_one), 1))
    above_left = above_count = np.zeros(0)
    for order, (parent, word, n, took, kinds) in enumerate(orders, 1):
        if order == 1:
            p = log_one
        else:
            node = word if order == 2 else trie.child(1, orders[1][1][parent], word)
            base = log_one[word] if order == 2 else trie.log_prob(1, node) if len(node) else np.zeros(0)
            p = np.log10(np.minimum((n - DISCOUNT) / above_count[parent] + above_left[parent] * 10.0**base, 1.0))
        left = np.maximum(1 - (took - DISCOUNT * kinds) / np.maximum(n, 1), 1e-12)
        trie.add(parent, word, p, np.log10(left))
        above_left, above_count = left, n
    return Trie.mapped(*trie.dump())


def build_words(counts: np.ndarray, log_one: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> Trie:
    """Trie of words 0..F-1 from all their kept bigrams and trigrams (code of 20 bits a word, count); those without their context are left out."""
    codes, orders = np.arange(len(counts)), [(np.zeros(len(counts), np.int64), np.arange(len(counts)), counts)]
    for order in (2, 3):
        code, n = grams[order]
        o = np.argsort(code)
        code, n = code[o], n[o]
        ok = np.isin(code >> 20, codes)
        code, n = code[ok], n[ok]
        orders.append((np.searchsorted(codes, code >> 20), code & ((1 << 20) - 1), n))
        codes = code
    below = [*orders[1:], (np.zeros(0, np.int64),) * 3]
    return build_trie(log_one, [(*x, np.bincount(y[0], y[2], len(x[2])), np.bincount(y[0], minlength=len(x[2]))) for x, y in zip(orders, below, strict=True)])


def backed_off(trie: Trie, order: int, context: np.ndarray, node: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The order's own probability where it has the n-gram, the shorter one's by the context's weight where it has that alone."""
    out = np.where(context >= 0, out + trie.log_back(order - 2, np.maximum(context, 0)), out) if trie.levels[order - 2].n else out
    return np.where(node >= 0, trie.log_prob(order - 1, np.maximum(node, 0)), out) if trie.levels[order - 1].n else out


def text_log_prob(trie: Trie, frequent: np.ndarray, first: np.ndarray, out: np.ndarray) -> np.ndarray:
    """log10 probability of every token of texts laid end to end.

    ``frequent``: the token's number in the trie, -1 for others; ``first``: where texts begin; ``out``: unigram probabilities.
    """
    if not trie.levels[0].n:
        return out
    context = frequent
    for order in range(2, len(trie.levels) + 1):
        before = np.full(len(frequent), -1, np.int64)
        before[1:] = context[:-1]
        before[first] = -1
        node = trie.child(order - 1, before, frequent)
        out = backed_off(trie, order, before, node, out)
        context = node
    return out


def _score(total: int, kinds: int, once: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, answer = right.column("part").to_numpy(), right.column("answer")
        size, held, token, number, count, *took = _chunk(left.column("texts")[0], [unpacked(answer[int(i)], 5) for i in np.flatnonzero(place < 0)])
        one = unigram(count, total, once)
        g = Grams(token, size, ~held, number, parts)
        asked = np.flatnonzero(place >= 0)
        n2, took2, kinds2, n3 = joined([unpacked(answer[int(i)], 4) for i in asked[np.argsort(place[asked])]], 4)
        two = np.zeros((3, len(g.two)), np.int64)
        two[:, g.order_two] = n2, took2, kinds2
        three = np.zeros(len(g.three), np.int64)
        three[g.order_three] = n3
        k2, k3 = np.flatnonzero(two[0]), np.flatnonzero(three)
        kept = np.cumsum(two[0] > 0) - 1
        none = np.zeros(len(k3))
        words = (np.zeros(len(count), np.int64), np.arange(len(count)), count, *took)
        trie = build_trie(one, [words, (g.two[k2] >> 32, g.two[k2] & 0xFFFFFFFF, *two[:, k2]), (kept[g.context[k3]], g.three[k3] & 0xFFFFFFFF, three[k3], none, none)])
        del g
        known = np.where(number >= 0, np.arange(len(count)), -1)
        gain = np.log10(count + 1.0)
        cols: list[list[np.ndarray]] = [[], [], []]
        end = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + BLOCK, "right")))
            a, n = token[end[lo] - size[lo] : end[hi - 1]], size[lo:hi]
            begin = np.cumsum(n) - n
            p = text_log_prob(trie, known[a], begin, one[a])
            base = np.add.reduceat(gain[a], begin) - n * np.log10(total + 1.0 * (kinds + 1))
            for out, v in zip(cols, (np.add.reduceat((count[a] > 0).astype(np.int64), begin), base, np.add.reduceat(p, begin)), strict=True):
                out.append(v)
            lo = hi
        keys = left.column("keys").combine_chunks()
        return pa.table([(keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten(), pa.array(held), pa.array(size), *[np.concatenate(c) for c in cols]], names=["key", "held", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_texts(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", share: float | None = None, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """(key, held, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts are written once, as places in their chunk's list of words. Without a ``share``, n-grams that occur twice are in the model;
    a share under 2**-20 is an error. ``piece``: training tokens for each part that n-grams are dealt into.
    """
    if share is not None and share < SHARE:
        raise ValueError("share must be 2**-20 or more")
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    kind = docs.schema["key"].dataType
    name = kind.simpleString()
    encoded = docs.mapInArrow(_encoded(chunk, to_arrow_type(kind)), f"chunk long, keys array<{name}>, texts binary, words binary, n binary, train long, listed long")
    encoded = materialize(encoded, "lm-input")
    chunks, total, listed = (int(x or 0) for x in encoded.agg(F.count("*"), F.sum("train"), F.sum("listed")).first())
    least = 2.0 if share is None else max(2.0, share * total)
    few, pieces = max(8, -(-listed // WORDS)), max(8, -(-total // piece))

    asked = encoded.select("chunk", "words", "n").mapInArrow(_listed(few), "chunk long, part long, words binary, n binary")
    numbered = asked.repartition(few, "part").groupBy("part").applyInArrow(_numbered(least, few), "chunk long, part long, answer binary, kinds long, once long")
    numbered = materialize(numbered, "lm-words")
    kinds, once = (int(x or 0) for x in numbered.agg(F.sum("kinds"), F.sum("once")).first())
    words = numbered.where("chunk >= 0").select("chunk", "part", "answer")

    # as many partitions as twice the chunks: they do not pile up, however many there are
    parts = max(8, 2 * chunks)
    by_chunk = lambda x: x.repartition(parts, "chunk").groupBy("chunk")
    asked = by_chunk(encoded.select("chunk", "texts")).cogroup(by_chunk(words.drop("part"))).applyInArrow(_asked(pieces), "chunk long, part long, asked binary")
    answered = asked.repartition(max(8, -(-pieces // 2)), "part").groupBy("part").applyInArrow(_summed(least, few), "chunk long, part long, answer binary")
    answered = materialize(answered, "lm-answers")
    by_word = lambda x: x.repartition(few, "part").groupBy("part")
    taken = by_word(words).cogroup(by_word(answered.where("chunk < 0"))).applyInArrow(_taken(few), "chunk long, part long, answer binary")
    right = taken.unionByName(answered.where("chunk >= 0"))
    scored = by_chunk(encoded.select("chunk", "keys", "texts")).cogroup(by_chunk(right)).applyInArrow(
        _score(total, kinds, once, pieces), f"key {name}, held boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    x = score_texts(docs, held)
    return x.select(F.col("key").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
