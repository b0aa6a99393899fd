"""Operator 8: byte passages that earlier documents have, removed with a logarithmic family of suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .packs import BITS, KeyQuestion, Messages, Packs, Question, Replies, answers_to, arrays, bits, by_part, columns, digits, expand, first_digits, flags, keyed, squeeze, stretches
from .substrings import id_keys
from .tokens import _MIX, covered, mix

#: Bytes of a passage, and of the grams (a multiple of 8) of which the least by hash tells where a passage is compared.
DEPTH, GRAM = 50, 24
#: A gram with more distinct surroundings than about this many is compared by whole passages instead.
CROWD = 180
#: Suffixes of a batch that enters the index at once, and places of a text that are hashed at once.
BATCH, STRETCH = 1 << 17, 1 << 15


def suffix_keys(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The first depth bytes of each suffix, as strings that sort as their bytes do (a last byte 1 guards zeros at the end)."""
    out = np.ones((len(starts), depth + 1), np.uint8)
    if len(starts):
        out[:, :depth] = np.lib.stride_tricks.sliding_window_view(text, depth)[starts]
    return out.view(f"S{depth + 1}").ravel()


class SuffixArray:
    """A text, the starts of its distinct suffixes of depth bytes, sorted, and the least id that has each."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, depth: int):
        self.text, self.starts, self.ids, self.depth = text, starts, ids, depth

    def keys(self) -> np.ndarray:
        return suffix_keys(self.text, self.starts, self.depth)

    def row(self) -> dict:
        """What a table of a level keeps of it."""
        return {"size": len(self.starts), "text": squeeze(self.text.tobytes()), "starts": squeeze(self.starts.tobytes()), "ids": squeeze(self.ids.tobytes())}

    def least(self, keys: np.ndarray) -> np.ndarray:
        """For sorted keys the least id that has each here; the largest number where none does."""
        theirs = self.keys()
        out = np.full(len(keys), np.iinfo(np.int64).max)
        if len(theirs):
            at = np.searchsorted(theirs, keys)  # both sorted: one pass over either
            at[at == len(theirs)] = 0
            hit = theirs[at] == keys
            out[hit] = self.ids[at[hit]]
        return out

    def merge(self, other: SuffixArray) -> SuffixArray:
        keys = np.concatenate([self.keys(), other.keys()])
        order = np.argsort(keys, kind="stable")  # finds and merges the two sorted runs
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        starts = np.concatenate([self.starts, other.starts + len(self.text)])[order]
        ids = np.concatenate([self.ids, other.ids])[order]
        return SuffixArray(np.concatenate([self.text, other.text]), starts[first], np.minimum.reduceat(ids, first), self.depth)


class IndexFamily:
    """Suffix arrays of which each is larger than all after it together, about: a new batch is scanned against every one
    and becomes the last; while the one before isn't larger, the two are merged. So a suffix is merged as often as the
    family doubles."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.levels = depth, []

    def whole(self) -> SuffixArray:
        """All levels as one."""
        none = np.zeros(0, np.int64)
        out = SuffixArray(np.zeros(0, np.uint8), none, none, self.depth)
        for level in reversed(self.levels):
            out = level.merge(out)
        return out

    def add(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray, before: list[SuffixArray] = ()) -> np.ndarray:
        """The suffixes at these starts, of documents with these ids; for each, the least id that has its first depth bytes,
        in the index or in the batch. What the arrays of an index before this one have counts as less than all ids."""
        if not len(starts):
            return ids
        keys = suffix_keys(text, starts, self.depth)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys = keys[first]
        least = np.minimum.reduceat(ids[order], first)
        own = SuffixArray(text, starts[order][first], least.copy(), self.depth)
        for level in self.levels:
            least = np.minimum(least, level.least(keys))
        for level in before:
            least[level.least(keys) < np.iinfo(np.int64).max] = np.iinfo(np.int64).min
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2].starts) <= len(self.levels[-1].starts):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merge(last)
        out = np.empty(len(starts), np.int64)
        out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
        return out


def stir(x: np.ndarray) -> np.ndarray:
    """Spreads bits enough to order grams by; half the work of mix()."""
    x = x * _MIX[0]
    x ^= x >> np.uint64(32)
    x *= _MIX[1]
    return x


def least_grams(buf: np.ndarray, depth: int, gram: int) -> np.ndarray:
    """For each window of depth bytes the least hash of its grams."""
    x, size = buf.astype(np.uint64), 1
    while size < 8:
        x = x[:-size] << np.uint64(8 * size) | x[size:]
        size *= 2
    g = stir(x)
    for at in range(8, gram, 8):
        g = stir((g[: len(g) - 8] >> np.uint64(1)) + x[at:])
    size, width = 1, depth - gram + 1
    while size * 2 <= width:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    if size < width:
        g = np.minimum(g[: len(g) - (width - size)], g[width - size :])
    return g


class Runs:
    """The passages (windows of depth bytes) of a pack, in runs of neighbours whose least gram by hash is the same.

    Which gram is least depends on the passage's bytes alone, so equal passages have the same one, wherever they are."""

    def __init__(self, texts: list[bytes], depth: int, gram: int):
        self.depth = depth
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.data = b"\0".join(texts) + b"\0"
        buf = np.frombuffer(self.data, np.uint8)
        self.offsets = np.cumsum(self.lengths + 1) - self.lengths - 1
        n = len(buf) - depth
        if n <= 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.key, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        g = np.empty(n, np.uint64)
        for a in range(0, n, STRETCH):  # by stretches that stay in a core's cache
            b = min(n, a + STRETCH)
            g[a:b] = least_grams(buf[a : b + depth - 1], depth, gram)
        ends = np.repeat(self.offsets + self.lengths, self.lengths + 1)[:n]
        valid = np.arange(n) + depth <= ends
        change = np.ones(n, bool)
        change[1:] = (g[1:] != g[:-1]) | (valid[1:] != valid[:-1])
        edge = np.flatnonzero(change)
        stop = np.append(edge[1:], n)
        keep = valid[edge]
        self.start, self.end = edge[keep], stop[keep]
        self.key = mix(g[self.start], 1)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1

    def by_key(self, keep: np.ndarray | None = None) -> np.ndarray:
        """Runs, sorted by key and then as they come."""
        at = np.arange(len(self.start)) if keep is None else np.flatnonzero(keep)
        return at[np.argsort(self.key[at], kind="stable")]

    def crowd_bits(self) -> np.ndarray:
        """For each run a number of 64 bits of which one is set, by the bytes that it begins with and its length: how many bits
        a gram's runs set tells how many unlike ones there are."""
        return np.uint64(1) << (self.hash_at(self.start) + (self.end - self.start).astype(np.uint64) * _MIX[2] >> np.uint64(58))

    def hash_at(self, starts: np.ndarray) -> np.ndarray:
        """A hash of the passage that begins at each place."""
        buf = np.frombuffer(self.data, np.uint8)
        h = np.zeros(len(starts), np.uint64)
        if len(starts) and self.depth >= 8:
            windows = np.lib.stride_tricks.sliding_window_view(buf, 8)
            for at in [*range(0, self.depth - 8, 8), self.depth - 8]:
                h = stir(h ^ windows[starts + at].view("<u8").ravel())
        elif len(starts):
            for at in range(self.depth):
                h = stir(h ^ buf[starts + at].astype(np.uint64))
        return mix(h, 2)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, sorted, whether two texts have each, and the bits of its surroundings."""
        order = self.by_key()
        key, doc = self.key[order], self.doc[order]
        if not len(key):
            return key, np.zeros(0, bool), key
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        last = np.append(first[1:], len(key)) - 1
        return key[first], doc[first] != doc[last], np.bitwise_or.reduceat(self.crowd_bits()[order], first)

    def routed(self, radix: int, reply: Replies) -> Routes:
        """The runs that others may have, with the key that each is sent by: its gram, or, where that is crowded, each of its
        passages by itself, by all of its bytes."""
        keys, _, _ = self.grams()
        said = answers_to(Grams(), keys, radix, reply)[np.searchsorted(keys, self.key)] if len(keys) else np.zeros(0, np.uint8)
        plain, crowded = np.flatnonzero(said == 1), np.flatnonzero(said == 2)
        n = self.end[crowded] - self.start[crowded]
        each = np.repeat(self.start[crowded] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        start = np.concatenate([self.start[plain], each])
        end = np.concatenate([self.end[plain], each + 1])
        doc = np.concatenate([self.doc[plain], np.repeat(self.doc[crowded], n)])
        key = np.concatenate([self.key[plain], self.hash_at(each)])
        order = np.argsort(key, kind="stable")
        return Routes(self.data, self.depth, start[order], end[order], doc[order], key[order])


class Routes:
    """Runs of a pack in the order of the keys that they are sent by. A run's segment are its bytes, with the whole of its last
    passage; equal segments of one range are sent once."""

    def __init__(self, data: bytes, depth: int, start: np.ndarray, end: np.ndarray, doc: np.ndarray, key: np.ndarray):
        self.data, self.depth, self.start, self.end, self.doc, self.key = data, depth, start, end, doc, key

    def entries(self, radix: int, ids: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, Segments]]:
        """For each range: the runs, which of the distinct segments each is, and those, with the least id that has each here."""
        part, rest = first_digits(self.key, radix)
        for p, at in stretches(part):
            found: dict[bytes, int] = {}
            number, data, more = found.setdefault, self.data, self.depth - 1
            which = np.array([number(data[a : b + more], len(found)) for a, b in zip(self.start[at].tolist(), self.end[at].tolist())], np.int64)
            least = np.full(len(found), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids[self.doc[at]])
            key = np.empty(len(found), np.uint64)
            key[which] = rest[at]
            yield p, at, which, Segments(key, least, [*found])


class Segments:
    """Distinct segments in the order of their keys, with the least id that has each."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, data: list[bytes]):
        self.key, self.ids, self.data = key, ids, data

    def message(self) -> bytes:
        head = arrays(np.array([len(s) for s in self.data], np.int64), self.ids, self.key)
        return len(head).to_bytes(8, "little") + head + squeeze(b"".join(self.data), 3)

    def part(self, at: slice, key: np.ndarray) -> Segments:
        return Segments(key, self.ids[at], self.data[at])

    @classmethod
    def merged(cls, messages: list[bytes]) -> tuple[Segments, list[tuple[np.ndarray, np.ndarray]]]:
        """The segments of all messages, each once, and for each message which of them it has, and its ids."""
        known: dict[bytes, int] = {}
        keys, least, own = [], [], []
        for m in messages:
            cut = int.from_bytes(m[:8], "little")
            lengths, ids, key = columns(m[8 : 8 + cut], "<i8", "<i8", "<u8")
            data, ends = expand(m[8 + cut :]), np.cumsum(lengths)
            which = np.empty(len(lengths), np.int64)
            for i, (b, n, x, k) in enumerate(zip(ends.tolist(), lengths.tolist(), ids.tolist(), key.tolist())):
                w = which[i] = known.setdefault(data[b - n : b], len(least))
                if w == len(least):
                    least.append(x)
                    keys.append(k)
                elif x < least[w]:
                    least[w] = x
            own.append((which, ids))
        key, ids, data = np.array(keys, np.uint64), np.array(least, np.int64), [*known]
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(key[order], ids[order], [data[k] for k in order.tolist()]), [(place[w], i) for w, i in own]


def flat(begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each range of n."""
    return np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Grams(KeyQuestion):
    """Values: whether two texts of a pack have a gram, and the bits of its surroundings. Answers: 0: one text has it, 1: several
    do, 2: several, with more unlike surroundings than one task should hold."""

    types = ("?", "<u8")
    #: Bits that so many unlike ones set, of 64.
    crowd = round(64 * (1 - np.exp(-CROWD / 64)))

    def reduce(self, values, first):
        if not len(first):
            return [values[0][:0], values[1][:0]]
        many = np.logical_or.reduceat(values[0], first) | (np.diff(np.append(first, len(values[0]))) > 1)
        return [many, np.bitwise_or.reduceat(values[1], first)]

    def settle(self, values, first):
        many, around = self.reduce(values, first)
        return np.where(many, np.where(np.bitwise_count(around) >= self.crowd, 2, 1), 0).astype(np.uint8)

    def write(self, answer):
        return squeeze(answer.tobytes()) if answer.any() else None

    def read(self, data, n):
        return np.frombuffer(expand(data), np.uint8, n)

    def nothing(self, n):
        return np.zeros(n, np.uint8)


class Earlier(Question):
    """Messages: segments and the least id of each. Answers: for each passage of each segment, whether a smaller id has it.
    Nodes hand on every segment once; where all of a range meet, they enter an index family in the order of ids."""

    def __init__(self, depth: int):
        self.depth = depth

    def up(self, messages: list[bytes], radix: int) -> list[tuple[int, bytes]]:
        s, _ = Segments.merged(messages)
        part, rest = digits(s.key, radix, BITS)
        return [(p, s.part(at, rest[at]).message()) for p, at in stretches(part)]

    def passages(self, s: Segments) -> np.ndarray:
        return np.array([len(x) for x in s.data], np.int64) - self.depth + 1

    def spread(self, s: Segments, own: list[tuple[np.ndarray, np.ndarray]], earlier: np.ndarray) -> list[bytes | None]:
        """What is known of each distinct segment's passages, for the children that have it."""
        n = self.passages(s)
        begins, out = np.cumsum(n) - n, []
        for which, ids in own:
            mine = n[which]
            f = earlier[flat(begins[which], mine)] | np.repeat(ids > s.ids[which], mine)
            out.append(bits(f) if f.any() else None)
        return out

    def top(self, messages: list[bytes]) -> list[bytes | None]:
        s, own = Segments.merged(messages)
        n = self.passages(s)
        earlier, begins = np.zeros(int(n.sum()), bool), np.cumsum(n) - n
        order = np.argsort(s.ids, kind="stable")
        for batch, found in scan(IndexFamily(self.depth), s, order):
            earlier[flat(begins[batch], n[batch])] = found < np.repeat(s.ids[batch], n[batch])
        return self.spread(s, own, earlier)

    def down(self, messages: list[bytes], replies: Replies, radix: int) -> list[bytes | None]:
        s, own = Segments.merged(messages)
        n = self.passages(s)
        ends, earlier = np.cumsum(n), np.zeros(int(n.sum()), bool)
        for p, at in stretches(digits(s.key, radix, BITS)[0]):
            if p in replies and at.stop > at.start:
                a, b = int(ends[at.start] - n[at.start]), int(ends[at.stop - 1])
                earlier[a:b] = flags(replies[p], b - a)
        return self.spread(s, own, earlier)


def scan(family: IndexFamily, s: Segments, order: np.ndarray, before: list[SuffixArray] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Adds segments to a family in this order, by batches of about BATCH passages: which they are, and the least id that has
    each of their passages, in the family or in the batch."""
    lengths = np.array([len(x) for x in s.data], np.int64)
    passages = lengths - family.depth + 1
    sums, k = np.cumsum(passages[order]), 0
    while k < len(order):
        stop = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + BATCH, side="right")))
        batch = order[k:stop]
        text = np.frombuffer(b"".join([s.data[i] for i in batch.tolist()]), np.uint8)
        n = passages[batch]
        starts = flat(np.cumsum(lengths[batch]) - lengths[batch], n)
        yield batch, family.add(text, starts, np.repeat(s.ids[batch], n), before)
        k = stop


def whole_characters(buf: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, widened to all bytes of each UTF-8 character that lost one."""
    if not len(buf):
        return gone
    character = np.cumsum((buf & 0xC0) != 0x80)
    hit = np.zeros(int(character[-1]) + 1, bool)
    hit[character[gone]] = True
    return hit[character]


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def with_cuts(schema: T.StructType, as_text: bool) -> T.StructType:
    added = ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", SPANS), ("kept", T.StringType() if as_text else T.BinaryType())
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in added]])


def cut(batch: pa.RecordBatch, runs: Runs, routes: Routes, radix: int, ids: np.ndarray, earlier: Replies, as_text: bool) -> pa.RecordBatch:
    """The rows of a pack without the passages that were answered to be earlier elsewhere, or that the pack itself has earlier."""
    depth, found = runs.depth, []
    for p, at, which, segments in routes.entries(radix, ids):
        order = np.argsort(segments.key, kind="stable")  # as they were sent
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.array([len(segments.data[k]) for k in order.tolist()], np.int64) - depth + 1
        said = flags(earlier[p], int(n.sum())) if p in earlier else np.zeros(int(n.sum()), bool)
        size = n[place[which]]
        f = said[flat((np.cumsum(n) - n)[place[which]], size)] | np.repeat(ids[routes.doc[at]] > segments.ids[which], size)
        found.append(flat(routes.start[at], size)[f])
    gone = covered(np.concatenate(found) if found else np.zeros(0, np.int64), depth, len(runs.data))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    first, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(runs.offsets, first, side="right") - 1
    sums = np.concatenate(([0], np.cumsum(gone)))
    n_removed = sums[runs.offsets + runs.lengths] - sums[runs.offsets]
    buf = np.frombuffer(runs.data, np.uint8)
    out = whole_characters(buf, gone) if as_text else gone
    at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    spans, kept = [], []
    for i, (o, n) in enumerate(zip(runs.offsets.tolist(), runs.lengths.tolist())):
        a, b = int(at[i]), int(at[i + 1])
        spans.append([{"first": x - o, "end": y - o} for x, y in zip(first[a:b].tolist(), end[a:b].tolist())])
        kept.append(runs.data[o : o + n] if a == b else buf[o : o + n][~out[o : o + n]].tobytes())
    left = pa.array([k.decode("utf-8") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs.lengths, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), left], names=[*batch.schema.names, "n_bytes", "n_removed", "spans", "kept"])


def sent_segments(runs: Runs, routes: Routes, radix: int, ids: np.ndarray) -> Messages:
    for p, _, _, segments in routes.entries(radix, ids):
        order = np.argsort(segments.key, kind="stable")
        yield p, Segments(segments.key[order], segments.ids[order], [segments.data[k] for k in order.tolist()]).message()


def remove_earlier(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, text: str = "text", id_col: str = "doc_id", as_text: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, spans (first byte and byte after the last of each removed stretch) and kept to every row. kept is
    binary; as_text: a string, without the characters that lost a byte.

    A byte of the UTF-8 text goes if a string of depth bytes covers it that also starts in a row with a smaller id.
    Strings are taken from the input, not from what is left; none runs over the end of a row.

    Passages are compared where their least gram sends them, so equal ones meet. First packs ask which of these grams
    two rows have at all; the stretches around those go up the tree of their ranges, each distinct one once. At its top
    they enter an index family in the order of ids, and what an earlier id has is found by the scans. A stretch that a
    third of all rows share costs a node one entry a child; a gram with a crowd of unlike stretches around it, such as
    a phrase that is in many texts, is sent passage by passage, by all of their bytes, so no task gets the crowd.

    Null and empty texts and those of fewer than depth bytes stay whole (kept is empty for null). Null ids count as the
    largest; rows with the same id don't take from each other. Repeated rows with unlike ids lose all but the one with
    the smallest id. Very long texts are packs of their own. An empty table gives an empty result. Other columns stay;
    those named like the added ones are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "spans", "kept")
    packs = Packs(docs, text, "suffixes")
    radix = packs.radix

    def runs_of(batch: pa.RecordBatch) -> Runs:
        return Runs([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()], depth, gram)

    def ask_grams(batch: pa.RecordBatch) -> Messages:
        h, many, around = runs_of(batch).grams()
        for p, at, keys in by_part(h, radix):
            yield p, keyed(keys, many[at], around[at])

    def ask_earlier(batch: pa.RecordBatch, grams: Replies) -> Messages:
        runs = runs_of(batch)
        return sent_segments(runs, runs.routed(radix, grams), radix, id_keys(batch.column(id_col)))

    def finish(batch: pa.RecordBatch, grams: Replies, earlier: Replies) -> Iterator[pa.RecordBatch]:
        runs = runs_of(batch)
        yield cut(batch, runs, runs.routed(radix, grams), radix, id_keys(batch.column(id_col)), earlier, as_text)

    grams = packs.ask(ask_grams, Grams(), "grams")
    earlier = packs.ask(ask_earlier, Earlier(depth), "earlier", grams)
    return packs.finish(finish, with_cuts(docs.schema, as_text), grams, earlier)


class PassageIndex:
    """An index family that lasts: batches of documents are added one after the other, and of each batch the passages go that a
    batch before it has, or a smaller id in it.

    A level is a table in the shared folder with a suffix array for each range of the gram keys. A new batch's passages are
    scanned against every level, range by range, and its arrays become the last level; while the one before isn't larger,
    the two are merged, sorted run with sorted run. So levels grow geometrically, a passage is merged as often as the
    family doubles, and nothing is sorted again. ranges: how many tasks share a level; all batches of an index have the
    same, so it is chosen for the size that the index will have (about 64 MB of text a range and level).

    Nulls, empty, short and very long texts, repeated rows and clashing names are as in remove_earlier(). Unlike there all
    passages are kept, since a later batch may have any of them: a level takes about six times its text.
    """

    def __init__(self, spark: SparkSession, depth: int = DEPTH, gram: int = GRAM, ranges: int = 64):
        self.spark, self.depth, self.gram, self.ranges = spark, depth, gram, ranges
        self.levels: list[tuple[DataFrame, int]] = []

    def add(self, docs: DataFrame, text: str = "text", id_col: str = "doc_id", as_text: bool = False) -> DataFrame:
        """The batch's rows with the columns of remove_earlier()."""
        docs = docs.drop("n_bytes", "n_removed", "spans", "kept")
        packs, depth, gram, ranges = Packs(docs, text, "index"), self.depth, self.gram, self.ranges

        def routes_of(batch: pa.RecordBatch) -> tuple[Runs, Routes]:
            runs = Runs([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()], depth, gram)
            at = runs.by_key()
            return runs, Routes(runs.data, depth, runs.start[at], runs.end[at], runs.doc[at], runs.key[at])

        def send(batch: pa.RecordBatch, pack: int) -> Iterator[pa.RecordBatch]:
            got = [*sent_segments(*routes_of(batch), ranges, id_keys(batch.column(id_col)))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([pack] * len(got), pa.int64()), pa.array([m for _, m in got], pa.binary())], names=["part", "pack", "message"])

        def compare(table: pa.Table, levels: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.Table.from_pylist([], schema=ANSWERED)
            table = table.sort_by("pack")
            part = table.column("part")[0].as_py()
            question, known = Earlier(depth), read_arrays(levels, depth)
            s, own = Segments.merged(table.column("message").to_pylist())
            n = question.passages(s)
            earlier, begins = np.zeros(int(n.sum()), bool), np.cumsum(n) - n
            family = IndexFamily(depth)
            for batch, found in scan(family, s, np.argsort(s.ids, kind="stable"), known):
                earlier[flat(begins[batch], n[batch])] = found < np.repeat(s.ids[batch], n[batch])
            array = family.whole()
            rows = [{"pack": p, "part": part, "answer": a} for p, a in zip(table.column("pack").to_pylist(), question.spread(s, own, earlier)) if a is not None]
            return pa.Table.from_pylist([*rows, {"part": part, **array.row()}], schema=ANSWERED)

        sent = packs._over(packs.df, (), send, "part int, pack long, message binary")
        known = self.table()
        done = written(sent.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(compare, ANSWERED_DDL), "index-batch")

        def finish(batch: pa.RecordBatch, earlier: Replies) -> Iterator[pa.RecordBatch]:
            yield cut(batch, *routes_of(batch), ranges, id_keys(batch.column(id_col)), earlier, as_text)

        self._push(done.where("text IS NOT NULL").select(*LEVEL))
        return packs.finish(finish, with_cuts(docs.schema, as_text), done.where("answer IS NOT NULL").select("pack", "part", "answer"))

    def table(self) -> DataFrame:
        """All levels: part, size, text, starts, ids."""
        out = self.spark.createDataFrame([], LEVEL_DDL)
        for level, _ in self.levels:
            out = out.union(level)
        return out

    def _push(self, level: DataFrame) -> None:
        depth = self.depth

        def merge(table: pa.Table) -> pa.Table:
            arrays_ = read_arrays(table, depth)
            out = arrays_[0]
            for x in arrays_[1:]:
                out = out.merge(x)
            return pa.Table.from_pylist([{"part": table.column("part")[0].as_py(), **out.row()}], schema=pa.schema([ANSWERED.field(n) for n in LEVEL]))

        size = lambda df: df.agg(F.sum("size")).first()[0] or 0
        n = size(level)
        if n:
            self.levels.append((level, n))
        while len(self.levels) > 1 and self.levels[-2][1] <= self.levels[-1][1]:
            (a, _), (b, _) = self.levels.pop(-2), self.levels.pop()
            both = written(a.union(b).groupBy("part").applyInArrow(merge, LEVEL_DDL), "index-level")
            self.levels.append((both, size(both)))


LEVEL = ["part", "size", "text", "starts", "ids"]
LEVEL_DDL = "part int, size long, text binary, starts binary, ids binary"
ANSWERED_DDL = "pack long, answer binary, " + LEVEL_DDL
ANSWERED = pa.schema([("pack", pa.int64()), ("answer", pa.binary()), ("part", pa.int32()), ("size", pa.int64()), ("text", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary())])


def read_arrays(table: pa.Table, depth: int) -> list[SuffixArray]:
    return [SuffixArray(np.frombuffer(expand(r["text"]), np.uint8), np.frombuffer(expand(r["starts"]), np.int64), np.frombuffer(expand(r["ids"]), np.int64), depth) for r in table.to_pylist()]


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_earlier(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
i AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
x AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM i),
s AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM x WHERE first < doc_id),
r AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g),
k AS (SELECT e.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
