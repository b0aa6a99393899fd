"""Words of many texts as arrays of positions and hashes, and hashes of their windows; no Python object a word."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes hashed at a time, and the longest word that is hashed by them.
STRETCH, LONG_WORD = 1 << 20, 1 << 16
_rng = np.random.Generator(np.random.Philox(key=20240131))
_TABLES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C17 * 4 + 3 & (1 << 64) - 1, 0xC2B2AE3D27D4EB4F & ~3 | 3]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the k-th base and of its inverse, modulo 2 to the 64th."""
    while len(_powers) <= k:
        base = _BASES[len(_powers)]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(STRETCH + LONG_WORD + 2, np.uint64(b))
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers.append((both[0], both[1]))
    return _powers[k]


class Words:
    """Words of texts (bytes), in order: where they start and end in buf, which text has them, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
        gap = _SPACE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        offsets = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.searchsorted(self.start, offsets))).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, k: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; k: 0 or 1, two independent ones."""
        out = np.zeros(len(self), np.uint64)
        table, (up, down) = _TABLES[k], powers(k)
        length = self.end - self.start
        i, n = 0, len(self)
        while i < n:
            if length[i] > LONG_WORD:
                out[i] = xxhash.xxh3_64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes(), seed=k + 1)
                i += 1
                continue
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, base + STRETCH, side="right")))
            long = np.flatnonzero(length[i:j] > LONG_WORD)
            j = i + int(long[0]) if len(long) else j
            s, e = self.start[i:j] - base, self.end[i:j] - base
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(table[self.buf[base : base + int(e[-1])]] * up[: int(e[-1])], out=sums[1:])
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(out + length.astype(np.uint64), k)

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """For each text its kept words, joined by one space."""
        kept = np.flatnonzero(keep)
        length = (self.end - self.start)[kept] + 1
        if not len(kept):
            return [b""] * len(self.counts)
        ends = np.cumsum(length)
        out = self.buf[np.arange(int(ends[-1])) + np.repeat(self.start[kept] - (ends - length), length)]
        out[ends - 1] = 0x20
        data = out.tobytes()
        last = np.concatenate(([0], ends))[np.searchsorted(kept, self.first)]
        return [data[a : max(a, b - 1)] for a, b in zip(last[:-1].tolist(), last[1:].tolist())]


def window_hashes(h: np.ndarray, length: int, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """A hash of each window of so many words, from the words' hashes: a window of an even length from its two halves,
    others from the window a word shorter. Windows run over the ends of texts; see fits()."""
    known = {} if known is None else known
    known[1] = h
    if length not in known:
        half = length // 2 if length % 2 == 0 else length - 1
        x = window_hashes(h, half, known)
        y = x if length % 2 == 0 else h
        n = max(0, len(h) - length + 1)
        known[length] = mix(x[:n] * _MIX[2] + y[half : half + n], length)
    return known[length]


def fits(words: Words, length: int) -> np.ndarray:
    """Which windows of so many words lie in one text."""
    n = max(0, len(words) - length + 1)
    return words.doc[:n] == words.doc[length - 1 : length - 1 + n]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in the windows of a length that begin at starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1) if len(starts) < 64 else np.add(step, np.bincount(starts, minlength=n + 1).astype(np.int32), out=step)
    step -= np.bincount(np.minimum(starts + length, n), minlength=n + 1).astype(np.int32)
    return np.cumsum(step)[:n] > 0
