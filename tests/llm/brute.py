"""Plain versions of the operators' results, document by document."""

import hashlib
import re
import zlib
from collections import Counter
from math import ceil, floor, log2, log10

import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NO_SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return [w.decode("utf-8", "surrogateescape") for w in pattern.findall((text or "").encode().translate(LOWER))]


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode())


def roots(ids, linked):
    """The smallest id that each can reach over ``linked`` pairs."""
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    w = words(text, NO_SPACE)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogateescape"), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash(docs):
    """``{doc_id: (fingerprint, component)}`` of ``(doc_id, text)`` rows with different ids."""
    fps = {i: fingerprint(t) for i, t in docs}
    ids = sorted(fps)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 3]
    root = roots(ids, linked)
    return {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def contamination(docs, items, size=10):
    """``[(doc_id, n_words, n_hit, item ids)]``."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in lengths:
                key = tuple(w[i : i + n])
                if len(key) == n and key in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def sha(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def phrases(docs, known):
    """``[(doc_id, n_words, n_base, first, last, labels)]``."""
    out = []
    for doc, text in docs:
        w = words(text)
        places, labels = [], set()
        for phrase, label in known.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out


def unigrams(docs):
    """``{doc_id: (held_out, n_tokens, n_known, N, base_score)}``."""
    split = {i: [*words(t, NO_SPACE), "</s>"] for i, t in docs}
    counts = Counter(w for i, ws in split.items() if fold(i) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (fold(i) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in split.items()}


def interpolated(docs):
    """``{doc_id: score}`` of a bigram model by deleted interpolation, counted word by word.

    Estimates are rounded to quarters of a doubling for the weights, as the operator's histogram has them.
    """
    split = {i: [*words(t, NO_SPACE), "</s>"] for i, t in docs}
    learned = [ws for i, ws in split.items() if fold(i) % 7 != 2]
    one = Counter(w for ws in learned for w in ws)
    two = Counter(p for ws in learned for p in zip(["<s>", *ws], ws))
    before = Counter({**one, "<s>": len(learned)})
    n, v = sum(one.values()), len(one)
    bucket = lambda c: int(log2(c)) + 1 if c else 0
    rounded = lambda p: 2 ** (round(log2(p * (v + 1)) * 4) / 4) if p else 0.0
    seen = Counter()
    for ws in learned:
        for p in zip(["<s>", *ws], ws):
            c, u, b = before[p[0]] - 1, one[p[1]] - 1, two[p] - 1
            seen[bucket(c), rounded(u / (n - 1)), rounded(b / c) if c else 0.0] += 1

    def fitted(cells, prior, start):
        w = start
        for _ in range(50):
            total = [prior * x for x in start]
            for (_, p1, p2), k in cells.items():
                parts = [w[0], w[1] * p1, w[2] * p2]
                total = [t + k * x / sum(parts) for t, x in zip(total, parts)]
            w = [t / sum(total) for t in total]
        return w

    pooled = fitted(seen, 0, [0.1, 0.4, 0.5])
    weights = {}

    def of(b):
        if b not in weights:
            w = fitted({k: c for k, c in seen.items() if k[0] == b}, 10, pooled)
            w = [w[0], w[1] + w[2], 0.0] if b == 0 else w
            w = [max(w[0], 1e-6), max(w[1], 1e-6), w[2]]
            weights[b] = [x / sum(w) for x in w]
        return weights[b]

    def score(ws):
        total = 0.0
        for p in zip(["<s>", *ws], ws):
            c = before[p[0]]
            w = of(bucket(c))
            total += log10(w[0] / (v + 1) + w[1] * one[p[1]] / n + (w[2] * two[p] / c if c else 0.0))
        return total

    return {i: score(ws) for i, ws in split.items()}


def mixture(docs, share=1.5, weights=(3, 1, 2), most=2, block_words=4096, least_slots=1 << 14):
    """``[(doc_id, size, source_size, target, taken, first slot)]`` of ``(doc_id, text, source)`` rows, word by word."""
    sized = [(i, len(words(t, NO_SPACE)), s) for i, t, s in docs]
    names = sorted({s for *_, s in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, x in sized if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > most * total[s]]
        for s in full or free:
            target[s] = most * total[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(target[s] for s in full)
        free = [s for s in free if s not in full]
    about = max(1, min(block_words, int(sum(target.values())) // least_slots))
    each, blocks, keys, start = {}, {}, {}, 0.0
    for s in names:
        each[s] = -(-total[s] // -(-total[s] // about)) if total[s] else 1
        blocks[s] = -(-total[s] // each[s])
        wanted = floor(target[s] / total[s] * blocks[s] * 65536) / 65536 if total[s] else 0.0
        keys[s], start = (ceil(start), ceil(start + wanted)), start + wanted
    bits = max(1, (ceil(start) - 1).bit_length())
    slots = {s: sorted(int(f"{k:0{bits}b}"[::-1], 2) for k in range(*keys[s])) for s in names}
    line = {s: [] for s in names}
    order = lambda i, n: (digest(i)[:3], n % 64, digest(i), n)
    for row, (i, n, s) in sorted(enumerate(sized), key=lambda r: order(*r[1][:2])):
        line[s] += [row] * n
    taken, first = [0] * len(sized), [None] * len(sized)
    for s in names:
        for r, slot in enumerate(slots[s]):
            block = r % blocks[s]
            for row in line[s][block * each[s] : (block + 1) * each[s]]:
                taken[row] += 1
                first[row] = slot if first[row] is None else min(first[row], slot)
    return [(i, n, total[s], target[s], k, f) for (i, n, s), k, f in zip(sized, taken, first)]


def digest(i):
    return hashlib.md5((str(i) if i is not None else "").encode()).hexdigest()
