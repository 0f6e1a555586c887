"""Plain versions of the contracts, over dictionaries of texts."""

import base64
import collections
import hashlib
import math
import re
import zlib

import xxhash

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def op1(docs, w=200):
    raw = [(i, (t or "").encode()) for i, t in docs]
    n = collections.Counter(b[k : k + w] for _, b in raw for k in range(len(b) - w + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if n[b[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def op2(docs):
    prints = []
    for i, t in docs:
        w = re.findall(SPACE, lower(t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(prints)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(prints):
        r = find(a)
        least[r] = i if r not in least or least[r] is None else least[r] if i is None else min(i, least[r])
    return [(i, f"{p:016x}", least[find(a)]) for a, (i, p) in enumerate(prints)]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def op3(docs):
    out = []
    for i, t in docs:
        t = t or ""
        kinds = [
            [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 12],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18],
            [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16],
        ]
        spans = sorted((s, k, e) for k, found in enumerate(kinds) for s, e in found)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        out.append((i, *map(len, kinds), sha(text.encode()), text))
    return out


ALLOWED = re.compile(r"[A-Za-z]+|[a-z]+([_/-]+[a-z]+)*[0-9]{0,4}|[0-9]+([_/-][0-9]+)*|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[=_+/-]+")


def entropy_spans(t, w=20):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % w, t or ""):
        x = m[0]
        if ALLOWED.fullmatch(x):
            continue
        bits = 3.2 if re.fullmatch("[0-9a-fA-F]+", x) else 3.9
        x = re.sub("0123456789|abcdefghij|ABCDEFGHIJ", "a" * 10, x)
        hot = [k for k in range(len(x) - w + 1) if -sum(n / w * math.log2(n / w) for n in collections.Counter(x[k : k + w]).values()) >= bits]
        if hot:
            out.append((m.start() + hot[0], m.start() + hot[-1] + w))
    return out


def op7(docs, w=35):
    words = [(i, re.findall(SPACE, t or "")) for i, t in docs]
    n = collections.Counter(tuple(x[k : k + w]) for _, x in words for k in range(len(x) - w + 1))
    out = []
    for i, x in words:
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if n[tuple(x[k : k + w])] > 1:
                gone[k : k + w] = [True] * w
        out.append((i, len(x), sum(gone), sha(" ".join(y for y, g in zip(x, gone, strict=True) if not g).encode())))
    return out


def op8(docs, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    grams = collections.defaultdict(set)
    for i, t in items:
        w = find(lower(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in docs:
        w = find(lower(t or ""))
        hit, got = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    got |= grams[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(got), sha(",".join(sorted(got)).encode()), bool(hit)))
    return out


def op9_base(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    return out


def op10_base(docs):
    tok = [(i, re.findall(SPACE, lower(t or "")) + [None]) for i, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tok]
    c = collections.Counter(w for (_, x), h in zip(tok, held, strict=True) if not h for w in x)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, x), h in zip(tok, held, strict=True)]


def op6(pages):
    best = {}
    for i, h in pages:
        best[h or ""] = max(best.get(h or "", i), i)
    return [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, h in pages]


def op10_score(docs, share, discount=0.75):
    """log10 probabilities by the model of words, bigrams and trigrams that the operator describes, from dictionaries."""
    tok = [(i, re.findall(SPACE, lower(t or "")) + [None]) for i, t in docs]
    train = [x for i, x in tok if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    one = collections.Counter(w for x in train for w in x)
    total, once = sum(one.values()), sum(n == 1 for n in one.values())
    least = max(1.0, share * total)
    unknown = (once + 1) / (total + 2)
    often = {w for w, n in one.items() if n >= least and w is not None}
    two = collections.Counter((a, b) for x in train for a, b in zip(x, x[1:], strict=False) if a in often and b in often)
    two = {g: n for g, n in two.items() if n >= max(2, least)}
    three = collections.Counter(g for x in train for g in zip(x, x[1:], x[2:], strict=False) if g[:2] in two and g[2] in often)
    three = {g: n for g, n in three.items() if n >= max(2, least)}
    p1 = lambda w: one[w] / total * (1 - unknown) if one[w] else unknown
    left1, left2 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (a, _), n in two.items():
        left1[a] -= (n - discount) / one[a]
    for (a, b, _), n in three.items():
        left2[a, b] -= (n - discount) / two[a, b]

    def p2(a, b):
        own = (two[a, b] - discount) / one[a] if (a, b) in two else 0.0
        return own + (left1[a] if a in often else 1.0) * p1(b)

    def p3(a, b, c):
        if (a, b) not in two:
            return p2(b, c)
        own = (three[a, b, c] - discount) / two[a, b] if (a, b, c) in three else 0.0
        return own + left2[a, b] * p2(b, c)

    out = []
    for i, x in tok:
        s = 0.0
        for k, w in enumerate(x):
            s += math.log10(p1(w) if k == 0 else p2(x[k - 1], w) if k == 1 else p3(x[k - 2], x[k - 1], w))
        out.append((i, len(x), s))
    return out


def op12(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    from itertools import permutations

    good, bad = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((part or "", {k for k, v in f.items() if v}, i in good, i in bad))
    out = []
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        gone = collections.Counter()
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                here = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                gone[c] += len(here)
                every = sum(c in x[0] for x in own)
                rows.append((part, order, k + 1, len(left), len(here), every - len(here), sum(x[0] == {c} for x in own), sum(x[1] for x in here), sum(x[2] for x in here)))
        out += [(*r, gone[r[1][r[2] - 1]]) for r in rows]
    return out


def op13(docs):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    found = []
    for i, t in docs:
        x = a.encode(" " + (t or ""), add_special_tokens=False)
        y = b.encode(t or "")
        xs = [bytes(byte[c] for c in a.id_to_token(k)) for k in x.ids]
        ys = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(xs) != whole or b"".join(ys) != whole:
            found.append((i, [], [], [], []))
            continue
        spans = []
        for ids, parts in ((x.ids, xs), (y, ys)):
            at, own = 0, []
            for k, p in zip(ids, parts, strict=True):
                own.append((k, at, at + len(p)))
                at += len(p)
            spans.append(own)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, links, last = [], [], 0
        p = q = 0
        for cut in cuts:
            ga, gb = [], []
            while p < len(spans[0]) and spans[0][p][2] <= cut:
                ga.append(spans[0][p])
                p += 1
            while q < len(spans[1]) and spans[1][q][2] <= cut:
                gb.append(spans[1][q])
                q += 1
            groups.append(",".join(str(k) for k, *_ in ga) + "|" + ",".join(str(k) for k, *_ in gb))
            links += [(k, m) for k, s, e in ga for m, u, v in gb if s < v and u < e]
            last = cut
        assert last == len(whole)
        found.append((i, x.ids, y, groups, links))
    count = collections.Counter(x for *_, links in found for x in set(links))
    top = collections.Counter()
    for (k, _), n in count.items():
        top[k] = max(top[k], n)
    return [(i, len(x), len(y), len(g), len(k), sum(count[p] == top[p[0]] for p in k), sum(count[p] for p in k), sha(";".join(g).encode()) if g else "") for i, x, y, g, k in found]


def shingle_set(t, n):
    w = re.findall(SPACE, lower(t or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def op11(docs, n=4, percent=85):
    sets = [shingle_set(t, n) for _, t in docs]
    group = list(range(len(docs)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                group[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        r = find(a)
        least[r] = i if r not in least or least[r] is None else least[r] if i is None else min(i, least[r])
    return [(i, len(s), least[find(a)]) for a, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]
