"""Monotone sequences in Elias-Fano form, and n-gram tries whose levels are made of them."""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
ONE = U(1)


class EliasFano:
    """A non-decreasing sequence of n values under ``universe``: low bits packed, high bits in unary."""

    def __init__(self, n: int, low: int, packed: np.ndarray, high: np.ndarray):
        self.n, self.low, self.packed, self.high = n, low, packed, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])  # before each word

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        v = values.astype(U)
        bits = np.zeros(-(-(n + (max(universe, 1) >> low) + 1) // 64) * 64, bool)
        bits[(v >> U(low)).astype(np.int64) + np.arange(n)] = True
        flat = ((v[:, None] >> np.arange(low, dtype=U)) & ONE).astype(bool).ravel() if low else np.zeros(0, bool)
        flat = np.concatenate([flat, np.zeros(-len(flat) % 64 + 64, bool)])
        return cls(n, low, np.packbits(flat, bitorder="little").view("<u8"), np.packbits(bits, bitorder="little").view("<u8"))

    def select0(self, j: np.ndarray) -> np.ndarray:
        """Place of the zero number j (from 0) in the unary part."""
        w = np.searchsorted(self.zeros, j, "right") - 1
        word, r = ~self.high[w], (j - self.zeros[w]).astype(np.int64)
        at = np.zeros(len(j), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count((word >> at.astype(U)) & U((1 << width) - 1)).astype(np.int64)
            go = r >= ones
            r = np.where(go, r - ones, r)
            at = np.where(go, at + width, at)
        return w * 64 + at

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), U)
        bit = i.astype(np.int64) * self.low
        w, s = bit >> 6, (bit & 63).astype(U)
        a = self.packed[w] >> s
        b = np.where(s > 0, self.packed[w + 1] << ((U(64) - s) & U(63)), U(0))
        return (a | b) & U((1 << self.low) - 1)

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the values whose high bits are ``h``."""
        begin = np.zeros(len(h), np.int64)
        some = h > 0
        begin[some] = self.select0(h[some] - 1) - (h[some] - 1)
        return begin, self.select0(h) - h

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value of the bucket of ``x`` that is not below it, and the bucket's end."""
        lo, end = self.bucket((x >> U(self.low)).astype(np.int64))
        hi = end.copy()
        want = x & U((1 << self.low) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo, end

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value of ``x``, -1 where it is not in the sequence."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        at, end = self.successor(x)
        hit = (at < end) & (self.lows(np.minimum(at, self.n - 1)) == (x & U((1 << self.low) - 1)))
        return np.where(hit, at, -1)


class Trie:
    """n-grams by level; a level's sequence is parent * width + label, so a parent's children are a range of it.

    ``child`` looks up the successor of a label relative to its context's range. Level values are
    log10 probabilities and backoff weights, quantised to 16 bits over [-24, 0] (a step is below 0.0004).
    """

    STEP = 24 / 65535

    def __init__(self, width: int):
        self.width, self.levels, self.prob, self.back = width, [], [], []

    def add(self, parents: np.ndarray, labels: np.ndarray, prob: np.ndarray, back: np.ndarray) -> None:
        """Add a level; (parent, label) ascending; a parent is an index of the level before (0 for the first)."""
        above = self.levels[-1].n if self.levels else 1
        self.levels.append(EliasFano.of(parents.astype(U) * U(self.width) + labels.astype(U), above * self.width))
        self.prob.append(self.quantised(prob))
        self.back.append(self.quantised(back))

    @classmethod
    def quantised(cls, log10: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(-log10, 0, 24) / cls.STEP).astype(np.uint16)

    def child(self, level: int, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Node at ``level`` (from 0) under each parent; -1 where there is none, or the parent or label is -1."""
        out = np.full(len(labels), -1, np.int64)
        if level >= len(self.levels):
            return out
        ok = np.flatnonzero((parents >= 0) & (labels >= 0))
        asked, back = np.unique(parents[ok].astype(U) * U(self.width) + labels[ok].astype(U), return_inverse=True)
        out[ok] = self.levels[level].find(asked)[back]
        return out

    def log_prob(self, level: int, node: np.ndarray) -> np.ndarray:
        return self.prob[level][node] * -self.STEP

    def log_back(self, level: int, node: np.ndarray) -> np.ndarray:
        return self.back[level][node] * -self.STEP

    def dump(self) -> tuple[dict, bytes]:
        parts, where, at = [], [], 0
        for e, p, b in zip(self.levels, self.prob, self.back, strict=True):
            for a in (e.packed, e.high, p, b):
                raw = a.tobytes() + b"\0" * (-a.nbytes % 8)
                where.append((at, len(a), a.dtype.str))
                parts.append(raw)
                at += len(raw)
        return {"width": self.width, "shapes": [(e.n, e.low) for e in self.levels], "where": where}, b"".join(parts)

    @classmethod
    def mapped(cls, head: dict, data: bytes) -> Trie:
        """The trie over one anonymous memory map, which holds all levels."""
        mem = mmap.mmap(-1, max(1, len(data)))
        mem.write(data)
        arrays = [np.frombuffer(mem, np.dtype(t), n, at) if n else np.zeros(0, np.dtype(t)) for at, n, t in head["where"]]
        trie = cls(head["width"])
        for k, (n, low) in enumerate(head["shapes"]):
            packed, high, prob, back = arrays[4 * k : 4 * k + 4]
            trie.levels.append(EliasFano(n, low, packed, high))
            trie.prob.append(prob)
            trie.back.append(back)
        return trie
