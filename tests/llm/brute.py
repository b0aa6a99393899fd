"""What the operators should give, worked out the plain way."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def order(i):
    """Null ids count as the largest."""
    return (i is None, i)


def substrings(rows, window=20):
    """{id: (words, removed, digest)}; ids are unlike."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def suffixes(rows, depth=50):
    """{id: (bytes, removed, spans, digest)}; ids are unlike."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if first.setdefault(b[k : k + depth], i) != i:
                gone[k : k + depth] = b"\1" * depth
        out[i] = (len(b), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard(rows, percent=75):
    """[(id, shingles, component, links)], for rows in order."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = i if least.get(r) is None else min(least[r], i)
        least.setdefault(r, None)
    return [(i, len(sets[k]), least[find(k)], links[k]) for k, (i, _) in enumerate(rows)]


def quality(text):
    """(words, word characters, symbols, repeated lines, words in repeated windows, failed)."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n")]
    dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = set()
    for k in range(len(w) - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def top_k(rows, k=5):
    """rows (id, vector): [(query, rank, id, score)], for queries divisible by 50."""
    import math

    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(fine):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(fine) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes {source: words} to {source: target}, by resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * share > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * share for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def cut_text(rows, depth=50):
    """{id: text without the characters of which a byte is in a passage that a smaller id has}; ids are unlike."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - depth + 1):
            if first.setdefault(b[k : k + depth], i) != i:
                gone[k : k + depth] = b"\1" * depth
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def verdict(text, piece, second, bands, script, full, halving):
    """Whether a text passes the base rules and the six bounds of its script."""
    import math

    own = (text or "").split()
    if quality(text)[5]:
        return False
    ids = [i for w in own for i in piece.encode(w)]
    chars, n = sum(map(len, own)), max(1, len(ids))
    low, high, most, bits, low2, high2 = bands[script]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    other = chars / max(1, sum(len(second.encode_ordinary(" " + w)) for w in own))
    return low <= chars / n <= high and sum(map(piece.is_byte, ids)) / n <= most and entropy >= bits - halving * max(0, math.log2(full / n)) and low2 <= other <= high2


def mixture(rows, weights=(5, 2, 1), most=3):
    """rows (id, text, source): [(id, text, source, copies)]."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    name = lambda x: "null" if x is None else str(x)
    sizes, keyed, times = Counter(), [], Counter()
    for i, text, source in rows:
        same = md5(f"mix:{name(i)}:{md5(text or '')}:{name(source)}")
        keyed.append((md5(f"mix:{same}:{times[same]}"), len((text or "").encode().split()), i, text, source))
        times[same] += 1
        sizes[source] += keyed[-1][1]
    want, before, out = targets(sizes, weights, most), Counter(), []
    for _, n, i, text, source in sorted(keyed, key=lambda x: x[0]):
        ratio = want[source] / sizes[source] if sizes[source] else 0.0
        copies = int(ratio) + (n > 0 and before[source] + n / 2 < (ratio - int(ratio)) * sizes[source])
        out.append((i, text, source, min(most, copies)))
        before[source] += n
    return out
