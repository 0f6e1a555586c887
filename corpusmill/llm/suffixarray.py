"""Suffix arrays by induced sorting, and permuted common prefixes, in vector operations.

The passes of induced sorting go bucket by bucket; within a bucket, what it induces into itself comes
in waves, as many as the longest run of its letter. Each wave is one vector operation.
"""

from __future__ import annotations

import numpy as np

#: the reduced string recurses while it has at most so many letters; beyond that it is sorted by doubling
LETTERS = 1024


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. ``t`` ends with a sentinel below all letters."""
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    turns = np.flatnonzero(step)
    small = np.ones(len(t), bool)
    small[:-1] = step[turns[np.searchsorted(turns, np.arange(len(t) - 1))]] > 0 if len(t) > 1 else True
    return small


def _deal(at: np.ndarray, letters: np.ndarray, into: list[list[np.ndarray]]) -> None:
    order = np.argsort(letters, kind="stable")
    at, letters = at[order], letters[order]
    cut = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    begin = np.concatenate([[0], cut])
    for a, b, c in zip(begin.tolist(), [*cut.tolist(), len(at)], letters[begin].tolist(), strict=True):
        into[c].append(at[a:b])


def induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-smaller ones in order within their letters."""
    seeded: list[list[np.ndarray]] = [[] for _ in range(letters)]
    larger: list[list[np.ndarray]] = [[] for _ in range(letters)]
    _deal(seeds, t[seeds], seeded)
    none = np.zeros(0, np.int64)

    def pull(now: np.ndarray, kind: bool, own: int, into: list[list[np.ndarray]]) -> np.ndarray:
        before = now[now > 0] - 1
        before = before[small[before] == kind]
        if not len(before):
            return none
        at = t[before]
        here = at == own
        if not here.all():
            _deal(before[~here], at[~here], into)
        return before[here]

    full: list[np.ndarray] = [none] * letters
    for c in range(letters):
        waves = larger[c]
        now = np.concatenate(waves) if waves else none
        waves = [now]
        while len(now):
            now = pull(now, False, c, larger)
            waves.append(now)
        full[c] = np.concatenate(waves)
        for s in seeded[c]:
            pull(s, False, c, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(letters)]
    out = [none] * letters
    smaller[0].append(np.array([len(t) - 1]))
    for c in range(letters - 1, -1, -1):
        now = np.concatenate(smaller[c]) if smaller[c] else none
        waves = [now]
        while len(now):
            now = pull(now, True, c, smaller)
            waves.append(now)
        pull(full[c][::-1], True, c, smaller)
        out[c] = np.concatenate([full[c], np.concatenate(waves)[::-1]])
    return np.concatenate(out)


def _names(t: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the substrings t[at..end] (both included), which are in order: equal ones have equal names."""
    n = end - at + 1
    same = n[1:] == n[:-1]
    left = np.flatnonzero(same)
    o = 0
    while len(left):
        ok = t[at[left] + o] == t[at[left + 1] + o]
        same[left[~ok]] = False
        o += 1
        left = left[ok]
        left = left[n[left] > o]
    return np.concatenate([[0], np.cumsum(~same)])


def _doubling(t: np.ndarray) -> np.ndarray:
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    span = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - span] = rank[span:] + 1 if span < n else 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """Suffixes of ``t`` in order; letters are 1..letters-1, and a single 0 ends ``t``."""
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        order = induce(t, small, lms, letters)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        at = order[is_lms[order]]
        end = np.append(lms[1:], len(t) - 1)
        name = _names(t, at, end[np.searchsorted(lms, at)])
        if name[-1] + 1 == len(lms):
            lms = at
        else:
            reduced = np.empty(len(lms), np.int64)
            reduced[np.searchsorted(lms, at)] = name
            # the last one is the sentinel's, and has name 0 alone
            kinds = int(name[-1]) + 1
            lms = lms[suffix_array(reduced, kinds) if kinds <= LETTERS else _doubling(reduced)]
    return induce(t, small, lms, letters)


def permuted_lcp(raw: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``raw``, the common prefix with the suffix before it in the order ``sa``.

    Where the letters before both suffixes are equal, the value is that of the place before less one; only the
    others, whose values add up to n log n at most, are compared, eight bytes at a time.
    """
    n = len(raw)
    sa = sa[1:]  # without the sentinel
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    pad = np.concatenate([raw, np.full(16, 0xFE, np.uint8)])
    word = np.zeros(n + 8, np.uint64)
    for k in range(8):
        word |= pad[k : n + 8 + k].astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(n)
    own = (phi < 1) | (at == 0)
    rest = np.flatnonzero(~own)
    own[rest] = raw[rest - 1] != raw[phi[rest] - 1]
    first = np.flatnonzero(own)
    size = np.zeros(len(first), np.int64)
    live = np.flatnonzero(phi[first] >= 0)
    while len(live):
        a, b = first[live] + size[live], phi[first[live]] + size[live]
        diff = word[a] ^ word[b]
        step = np.where(diff == 0, 8, np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
        size[live] += step
        live = live[diff == 0]
    last = np.maximum.accumulate(np.where(own, at, 0))
    value = np.zeros(n, np.int64)
    value[first] = size
    return value[last] - (at - last)


def repeated_starts(parts: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each byte string, the places where a ``window``-byte string starts that starts elsewhere too, in any of them."""
    sizes = np.array([len(p) for p in parts], np.int64)
    if not len(sizes):
        return []
    sep = np.array([0xFF], np.uint8)  # in no UTF-8 text
    raw = np.concatenate([x for p in parts for x in (p, sep)])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    sa = suffix_array(np.append(raw.astype(np.int16) + 1, 0).astype(np.int16), 257)
    plcp = permuted_lcp(raw, sa)
    lcp = np.append(plcp[sa[1:]], 0)
    hit = np.zeros(len(raw), bool)
    hit[sa[1:]] = (lcp[:-1] >= window) | (lcp[1:] >= window)
    return [np.flatnonzero(hit[b : b + max(0, s - window + 1)]) for b, s in zip(begin, sizes, strict=True)]
