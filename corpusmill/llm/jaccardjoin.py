"""Exact join of texts on the Jaccard similarity of their word n-grams (operator 11).

Two sets of sizes n and m at p percent or more have at least p (n + m) / (100 + p) shingles in common, and sizes at most 100 : p apart. So in one order
of all shingles, rare ones first, both prefixes of (100 - p) percent of the set hold the first shingle in common. What shares
a prefix shingle is cut into tiles by bands of sizes: only equal or neighbouring bands can link. Tiles of sizes alone would compare all pairs of
texts of like length.

Each set has a bitmap of hashed parities: as many places as shingles, rounded up to a power of two, and 1,024 at least. A longer bitmap is folded to the
length of a shorter one. Two bitmaps differ in no more places than the sets differ in shingles, so their bit count bounds the overlap from
above; what passes is decided by intersecting the sorted arrays of shingles.

Three rounds. The first compares every set with one hub of each tile it is in, so that large groups of near copies become components at the price
of a pair for each copy. The second compares it within a tile with the one set of another component before it whose bitmap is nearest, which joins groups
whose hub is far from most. The last compares within tiles all sets that are still of different components but the hubs, which are done. Large tiles are cut
into blocks, pairs of which are tasks of bounded size. No pair that could link two components goes without a look.

Equal sets are one node from the start. A shingle is known by its 64-bit hash, a set by 128 bits and its size.

Cases: a null text is an empty one; texts without words have no set and link with nothing, not even each other; with fewer words than a shingle
the whole sequence is one; null ids are never a component's id unless there is no other; repeated rows are texts like others; a text of any length is one set; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import _seq
from corpusmill.llm._spark import BITS, bit, bitmap, components, discard, marked, materialize, numbered_rows

#: places of a bitmap at the least, in words of 64 bits
WORDS = 16
#: sets of one block of a tile, at most
BLOCK = 1024
#: shingles that a task counts at a time
PIECE = 1 << 21


def distinct_shingles(texts: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges a..z of the texts: hashes of the distinct shingles of each, sorted, and their text counted from a.

    Shingles are of lower-cased words; a text of fewer words has one of them all, and one of none has none.
    """
    data, offs = _seq.buffers(texts)
    for a, z in _seq.cuts(offs, 1 << 20):
        w = _seq.Words(_seq.LOWER[data[offs[a] : offs[z]]], offs[a : z + 1] - offs[a], _seq.NOT_SPACE)
        words = np.diff(w.off)
        n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
        doc = np.repeat(np.arange(z - a), n)
        at = w.off[:-1][doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
        h = _seq.Rolling(w.values(0), 0).of(at, np.minimum(at + shingle, w.off[1:][doc])).view(np.int64)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        yield a, z, doc[new], h[new]


def common_shingles(df: DataFrame, text: str, shingle: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts, sorted by hash, and how many texts: ``most`` of them at most, by one pass over all texts.

    Tasks send what they see in several texts of a piece. The counts only order shingles: no result hangs on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def several() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["h", "n"])

        for b in batches:
            for *_, h in distinct_shingles(b.column(0), shingle):
                held.append(h)
                if sum(map(len, held)) >= PIECE:
                    yield several()
        if held:
            yield several()

    found = df.select(F.col(text).cast("binary")).mapInArrow(run, "h long, n long")
    found = materialize(found.groupBy("h").agg(F.sum("n").alias("n")), "jaccard-common")
    times = found.groupBy("n").agg(F.count("*").alias("m")).toArrow()  # as many rows as there are counts
    n, m = times.column("n").to_numpy(), times.column("m").to_numpy()
    order = np.argsort(-n)
    enough = n[order][np.cumsum(m[order]) <= most]
    t = found.where(F.col("n") >= (int(enough[-1]) if len(enough) else 1 << 62)).toArrow()
    discard(found)
    order = np.argsort(t.column("h").to_numpy())
    return t.column("h").to_numpy()[order], t.column("n").to_numpy()[order]


def signatures(df: DataFrame, key: str, text: str, shingle: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, key, i, j, n, sketch, prefix): two hashes of the set of shingles, its size, bitmap, and prefix in the order rare to common."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for b in batches:
            for a, z, doc, h in distinct_shingles(b.column(2), shingle):
                first = np.searchsorted(doc, np.arange(z - a + 1))
                n = np.diff(first)
                has = np.flatnonzero(n)
                ids = np.zeros((2, z - a), np.uint64)
                place = _seq.mix(h.view(np.uint64))
                for k, salt in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                    if len(has):
                        ids[k, has] = np.add.reduceat(_seq.mix(h.view(np.uint64) ^ np.uint64(salt)), first[:-1][has])
                words = np.maximum(WORDS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).astype(np.int64).clip(0))
                ends = np.append(0, np.cumsum(words))
                odd = np.bincount(64 * ends[doc] + (place & (64 * words[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=64 * int(ends[-1])) & 1
                sketch = np.packbits(odd.astype(bool), bitorder="little").view("<i8")
                rank = np.zeros(len(h), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    rank = np.where(often[at] == h, times[at], 0)
                order = np.lexsort((h, rank, doc))
                most = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                take = np.arange(len(h)) - first[:-1][doc] < most[doc]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)).astype(np.int32)), pa.array(h[order][take]))
                flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sketch))
                cols = [b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), *[pa.array(x.view(np.int64)) for x in ids], pa.array(n.astype(np.int64)), flat, lists]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "key", "i", "j", "n", "sketch", "prefix"])

    kind = df.schema[key].dataType.simpleString()
    return df.select("row", F.col(key), F.col(text).cast("binary")).mapInArrow(run, f"row long, key {kind}, i long, j long, n long, sketch array<long>, prefix array<long>")


def least_common(n: Column, m: Column, percent: int) -> Column:
    """What sets of sizes ``n`` and ``m`` have in common at the least if they link."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def may_meet(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` that first meet at places ``pos`` and ``at`` of their prefixes can link."""
    need = least_common(n, m, percent)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (pos <= n - need) & (at <= m - need)


class Bitmaps:
    """Bitmaps of different lengths, in one array."""

    def __init__(self, lists: pa.ListArray):
        self.values = lists.flatten().to_numpy().view(np.uint64)
        off = lists.offsets.to_numpy().astype(np.int64)
        self.start, self.words = off[:-1] - off[0] if len(off) else off, np.diff(off)

    def folded(self, rows: np.ndarray, words: int) -> np.ndarray:
        """The bitmaps of ``rows``, folded to ``words`` words each."""
        out = np.empty((len(rows), words), np.uint64)
        for w in np.unique(self.words[rows]):
            k = np.flatnonzero(self.words[rows] == w)
            whole = self.values[self.start[rows[k]][:, None] + np.arange(w)]
            out[k] = np.bitwise_xor.reduce(whole.reshape(len(k), w // words, words), axis=1)
        return out

    def differ(self, i: np.ndarray, other: Bitmaps, j: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """In how many places the bitmaps of rows ``i`` differ from those of rows ``j`` of ``other``."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.words[i], other.words[j])
        for w in np.unique(least):
            at = np.flatnonzero(least == w)
            for k in np.array_split(at, max(1, len(at) * int(w) // most)):
                out[k] = np.bitwise_count(self.folded(i[k], w) ^ other.folded(j[k], w)).sum(1, dtype=np.int64)
        return out


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` whose bitmaps differ in ``differ`` places can link."""
    return differ <= n + m - 2 * -(-percent * (n + m) // (100 + percent))


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}s")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "an", "bn", "as", "bs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.arange(b.num_rows)
            differ = Bitmaps(b.column(4)).differ(every, Bitmaps(b.column(5)), every)
            yield b.select([0, 1]).filter(pa.array(may_link(b.column(2).to_numpy(), b.column(3).to_numpy(), differ, percent)))

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, df: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets link, by intersecting sorted arrays. Only texts that are asked for are read."""
    shared = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("row")), "row")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            b = whole.filter(pa.array(marked(shared.value, whole.column(2).to_numpy())))
            for a, z, doc, h in distinct_shingles(b.column(1), shingle):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(z - a + 1)).astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), lists], names=["row", "s"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (b.column(2), b.column(3))] if b.num_rows else []
            keep = np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                x, y = (v[o[k] : o[k + 1]] for v, o in sides)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[k] = (100 + percent) * both >= percent * (len(x) + len(y))
            yield b.select([0, 1]).filter(pa.array(keep))

    sets = materialize(df.select("row", F.col(text).cast("binary"), bit("row")).mapInArrow(arrays, "row long, s array<long>"), "jaccard-arrays")
    of = lambda c: sets.select(F.col("row").alias(c), F.col("s").alias(f"{c}s")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "as", "bs")
    out = materialize(both.mapInArrow(decide, "a long, b long"), "jaccard-links")
    discard(sets)
    return out


def hub_pairs(here: DataFrame, percent: int) -> DataFrame:
    """Each set with the hub, the least set, of every tile of its own and the neighbouring bands that it is in."""
    hubs = here.groupBy("at", "band").agg(F.min(F.struct("node", "n", "pos")).alias("h"))
    hubs = hubs.groupBy("at").agg(F.collect_list(F.struct("band", "h.*")).alias("hubs"))  # a hub a band, and a band a ratio of sizes
    near = F.filter("hubs", lambda h: (F.abs(h["band"] - F.col("band")) <= 1) & (h["node"] != F.col("node")) & may_meet(F.col("n"), F.col("pos"), h["n"], h["pos"], percent))
    x = here.join(hubs.hint("merge"), "at").select("node", F.explode(near).alias("h"))
    return x.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()


def tile_pairs(here: DataFrame, sets: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """All pairs of sets of different components that meet in a tile and that places, sizes and bitmaps do not rule out; of each set only one if ``nearest``."""
    both = F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("own"))))
    rows = here.select("at", "node", "n", "pos", "comp", both.alias("t")).select("at", "node", "n", "pos", "comp", "t.*")
    # the hubs of both bands have been compared with all of the tile
    hub = lambda c: F.min(F.when(c, F.col("node")))
    sizes = rows.groupBy("at", "tile").agg(F.count("*").alias("c"), F.count_if("own").alias("o"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub(F.col("own")).alias("h"), hub(~F.col("own")).alias("g"))
    sizes = sizes.where("lo <> hi AND (o > 2 OR (o = 2 AND c > 3))").select("at", "tile", F.ceil(F.col("c") / BLOCK).alias("blocks"), "h", F.coalesce("g", F.lit(-1)).alias("g"))
    x = rows.join(sizes.hint("merge"), ["at", "tile"]).where("node <> h AND node <> g")
    own = F.pmod(F.xxhash64("node"), "blocks")
    x = x.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x = x.join(sets.select("node", "sketch").hint("merge"), "node")
    x = x.select("at", "tile", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "own", "node", "n", "pos", "comp", "sketch")
    x = x.repartition("at", "tile", "first", "second").sortWithinPartitions("at", "tile", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            last = _last_tile(t)
            if last:
                yield from _matches(t.slice(0, last), percent, nearest)
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from _matches(rest, percent, nearest)

    return x.mapInArrow(run, "a long, b long").distinct()


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _last_tile(t: pa.Table) -> int:
    """Where the last block pair of the table begins: it may go on in the next batch. No more rows than two blocks are ever kept."""
    keys = _numbers(t, "at", "tile", "first", "second")
    if not t.num_rows:
        return 0
    differs = np.zeros(t.num_rows, bool)
    for k in keys:
        differs |= k != k[-1]
    return int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0


def _matches(t: pa.Table, percent: int, nearest: bool, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of whole block pairs: the sets of each one's largest component are only compared with the others, all others with all before.

    ``nearest``: of each set's pairs only the one whose bitmaps differ least.
    """
    at, tile, one, two, block, node, n, pos, comp = _numbers(t, "at", "tile", "first", "second", "block", "node", "n", "pos", "comp")
    own = np.asarray(t.column("own").to_pylist(), bool)
    sketch = Bitmaps(t.column("sketch").combine_chunks())
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (tile[1:] != tile[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    of = np.cumsum(new) - 1
    order = np.lexsort((comp, of))
    run = np.ones(len(at), bool)
    run[1:] = (of[order][1:] != of[order][:-1]) | (comp[order][1:] != comp[order][:-1])
    size = np.diff(np.append(np.flatnonzero(run), len(at)))
    size = size[np.cumsum(run) - 1]  # of each row's component, in that order
    by_size = np.lexsort((comp[order], -size, of[order]))
    order, size = order[by_size], size[by_size]
    start = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
    local = np.arange(len(at)) - start[of[order]]
    before = np.where(local >= size[start][of[order]], local, 0)  # a row of the largest component looks at none
    total = np.append(0, np.cumsum(before))
    for lo, hi in _seq.cuts(total, most):
        c = before[lo:hi]
        j = np.repeat(np.arange(lo, hi), c)
        i = np.arange(len(j)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[of[order[lo:hi]]], c)
        i, j = order[i], order[j]
        ok = (comp[i] != comp[j]) & (own[i] | own[j]) & ((one[i] == two[i]) | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (pos[i] <= n[i] - need) & (pos[j] <= n[j] - need)
        i, j = i[ok], j[ok]
        differ = sketch.differ(i, sketch, j)
        ok = may_link(n[i], n[j], differ, percent)
        if nearest:
            order_of = np.flatnonzero(ok)
            order_of = order_of[np.lexsort((differ[order_of], j[order_of]))]
            ok = order_of[np.append(True, j[order_of][1:] != j[order_of][:-1])[: len(order_of)]]
        a, b = node[i[ok]], node[j[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """(row, key, n, component) of every row: the size of its set, and the least key that links of ``percent`` or more lead to."""
    return similar_rows(numbered_rows(df.select(key, text), "jaccard-rows"), key, text, shingle, percent)


def similar_rows(docs: DataFrame, key: str, text: str, shingle: int, percent: int, apart: bool = True, first: DataFrame | None = None) -> DataFrame:
    """The same, of rows that have a number of their own, ``row``. Without ``apart``, texts without words are one component.

    ``first``: pairs (a, b) of rows that another search has found; round one looks at them too.
    """
    some = F.col("n") >= (1 if apart else 0)
    found = materialize(signatures(docs, key, text, shingle, percent, common_shingles(docs, text, shingle)), "jaccard-signatures")
    rows = materialize(found.select("row", "key", "i", "j", "n"), "jaccard-ids")
    nodes = materialize(rows.where(some).groupBy("i", "j", "n").agg(F.min("row").alias("node"), F.min("key").alias("key")), "jaccard-nodes")
    sets = found.join(nodes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi").select(F.col("row").alias("node"), "n", "sketch", "prefix")
    sets = materialize(sets, "jaccard-sets")
    discard(found)
    here = materialize(shared_places(sets, percent), "jaccard-places")
    pairs = hub_pairs(here, percent)
    if first is not None:
        # each search is written on its own: in one plan all their shuffles would be planned anew and run at once
        pairs, first = materialize(pairs, "jaccard-hub-pairs"), materialize(first, "jaccard-first")
        node_of = materialize(rows.join(nodes.select("i", "j", "n", "node").hint("merge"), ["i", "j", "n"]).select("row", "node"), "jaccard-node-of")
        end = lambda c: node_of.select(F.col("row").alias(c), F.col("node").alias(f"{c}n"))
        ends = first.join(end("a"), "a").join(end("b"), "b").where("an <> bn")
        pairs = materialize(pairs.unionByName(ends.select(F.least("an", "bn").alias("a"), F.greatest("an", "bn").alias("b"))).distinct(), "jaccard-pairs")
    links = verified(materialize(bounded(pairs, sets, percent), "jaccard-hubs"), docs, text, shingle, percent)
    roots = materialize(components(links, "jaccard-star"), "jaccard-roots")
    root_of = materialize(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "jaccard-components")
    for nearest in (True, False):
        left = here.join(root_of.hint("merge"), "node").select("at", "band", "node", "n", "pos", F.col("root").alias("comp"))
        more = verified(materialize(tile_pairs(left, sets, percent, nearest), "jaccard-tiles"), docs, text, shingle, percent)
        of = lambda c, r: root_of.select(F.col("node").alias(c), F.col("root").alias(r)).hint("merge")  # noqa: B023, E731
        ends = more.join(of("a", "x"), "a").join(of("b", "y"), "b")
        above = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "jaccard-star").select(F.col("node").alias("root"), F.col("root").alias("top"))
        root_of = materialize(root_of.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "jaccard-components")
    discard(here)
    named = nodes.join(root_of, "node").select("i", "j", "n", "key", "root")
    least = named.groupBy("root").agg(F.min("key").alias("component"))
    named = materialize(named.join(least.hint("merge"), "root").select("i", "j", "n", "component"), "jaccard-named")
    alone = rows.where(~some).select("row", "key", "n", F.col("key").alias("component"))
    return rows.where(some).join(named.hint("merge"), ["i", "j", "n"]).select("row", "key", "n", "component").unionByName(alone)


def shared_places(sets: DataFrame, percent: int) -> DataFrame:
    """(at, band, node, n, pos) of the prefix shingles that several sets have, and of some others."""
    several = sets.select(F.explode("prefix").alias("at")).groupBy("at").agg(F.count("*").alias("c")).where("c > 1")
    shared = bitmap(several, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            at, place = lists.flatten().to_numpy(), b.column(3).flatten().to_numpy()
            of = np.repeat(np.arange(b.num_rows), size)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            k = marked(shared.value, place)
            node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at[k]), pa.array(node[of[k]]), pa.array(n[of[k]]), pa.array(pos[k].astype(np.int64))], names=["at", "node", "n", "pos"])

    places = F.transform("prefix", lambda x: F.pmod(F.xxhash64(x), F.lit(BITS)))
    x = sets.select("node", "n", "prefix", places.alias("places")).mapInArrow(run, "at long, node long, n long, pos long")
    # bands a little wider than the ratio, so that sizes that link are never two bands apart
    return x.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / (percent - 1))))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[k:k + 3], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(2, len(w) - 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM g a JOIN g b USING (s) WHERE a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
