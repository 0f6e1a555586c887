"""Vectorised work on token sequences: words of a byte buffer, rolling hashes, anchored segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)
_B = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_c = np.arange(256)
NOT_SPACE = ~((_c == 0x20) | ((_c >= 9) & (_c <= 13)))
ALNUM = ((_c >= 0x30) & (_c <= 0x39)) | ((_c >= 0x61) & (_c <= 0x7A)) | (_c >= 0x80)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        b = _B[which]
        inv = U(pow(int(b), -1, 1 << 64))
        out = []
        for x in (b, inv):
            a = np.full(n + n // 4, x, U)
            a[0] = U(1)
            out.append(np.multiply.accumulate(a))
        _POWERS[which] = tuple(out)
    return _POWERS[which]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Rolling:
    """Hashes of any range of ``values``, from prefix sums: a polynomial modulo 2**64.

    For ranges of bounded length only. On sequences of two values that alternate as Thue and Morse's does, ranges of
    1,024 items and more collide; what is longer, or decides that sequences are equal, is hashed by :func:`strong`.
    """

    def __init__(self, values: np.ndarray, which: int):
        n = len(values)
        self.p, self.q = powers(which, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * self.p[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.q[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))


def strong(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of 128 bits of every range of ``data``, as rows of two signed longs."""
    of = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([of(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def strong64(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of 64 bits of every range of ``data``, as signed longs."""
    of = xxhash.xxh3_64_intdigest
    return np.array([of(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], U).view(np.int64)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, nulls as empty, and where each value starts and ends."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def cuts(off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row."""
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        out.append((a, b))
        a = b
    return out


class Words:
    """Words of many texts: first byte, end byte, and for each text its first word's index."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray):
        w = kind[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[off] = True
        begins = w.copy()
        begins[1:] &= ~w[:-1] | first[1:-1]
        ends = w.copy()
        ends[:-1] &= ~w[1:] | first[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.off = np.searchsorted(self.start, off)
        self.buf, self.inside = buf, w

    def values(self, which: int) -> np.ndarray:
        """A hash of every word: eight bytes at a time go through a bijective mixer; words over 256 bytes by XXH3."""
        size = self.end - self.start
        h = mix(size.astype(U) + _B[which])
        pad = np.concatenate([self.buf, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(pad) - 8, "<u8", pad, strides=(1,))
        at = np.flatnonzero(size <= 256)
        for k in range(0, 256, 8):
            if not len(at):
                break
            left = np.minimum(size[at] - k, 8).astype(U)
            h[at] = mix((h[at] ^ (eight[self.start[at] + k] & (ALL >> (U(64) - left * U(8))))) * _B[which])
            at = at[size[at] > k + 8]
        for i in np.flatnonzero(size > 256):
            h[i] = xxhash.xxh3_64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes(), which)
        return h

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each with one space behind it; where each begins and ends."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        own = np.ones(int(end[-1]) + 1 if len(end) else 0, bool)
        own[end] = False
        out = np.full(len(own), 0x20, np.uint8)
        out[own] = self.buf[self.inside]
        return out.tobytes(), end - size, end


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, span = h, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (w - span)], m[w - span :]) if w > span else m


def segments(values: np.ndarray, off: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Cut the windows of every sequence into runs that share an anchor.

    The anchor of a window is the leftmost of its ``gram``-item pieces with the least hash, so equal
    windows have equal anchors, at equal places, wherever they occur. A run holds consecutive windows
    with one anchor hash. Gives arrays: seq, start (item within the sequence), windows, key (the anchor's hash),
    first and end (items of the run, over all sequences), inner (the anchor recurs: windows may repeat within the run).
    """
    none = {k: np.zeros(0, t) for k, t in (("seq", np.int64), ("start", np.int64), ("windows", np.int64), ("key", U), ("first", np.int64), ("end", np.int64), ("inner", bool))}
    n = len(values)
    if n < window:
        return none
    roll = Rolling(values, 0)
    at = np.arange(n - gram + 1)
    h = roll.of(at, at + gram)
    packed = (h & ~U((1 << 28) - 1)) | at.astype(U)
    best = (sliding_min(packed, window - gram + 1) & U((1 << 28) - 1)).astype(np.int64)
    key = h[best]
    lens = np.diff(off)
    room = np.maximum(lens - window + 1, 0)
    seq = np.repeat(np.arange(len(lens)), room)
    if not len(seq):
        return none
    begin = np.repeat(off[:-1], room)
    pos = begin + np.arange(len(seq)) - np.repeat(np.cumsum(room) - room, room)
    key, best = key[pos], best[pos]
    new = np.ones(len(seq), bool)
    new[1:] = (key[1:] != key[:-1]) | (seq[1:] != seq[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(seq)) - 1
    first, last = pos[a], pos[b]
    return {"seq": seq[a], "start": first - begin[a], "windows": last - first + 1, "key": key[a], "first": first, "end": last + window, "inner": best[a] != best[b]}


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges; runs that touch are one."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    a = np.flatnonzero(new)
    return s[a], e[np.append(a[1:], len(s)) - 1]
