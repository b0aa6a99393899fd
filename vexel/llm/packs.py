"""Rows packed into blocks of a bounded size, and the exchange by which blocks learn what others hold.

Operators that compare every passage of every text would shuffle a row a passage. Here a table is first written as packs:
a row a pack, holding some megabytes of rows as compressed Arrow, in a table bucketed by pack, so that packs stay where they
are and only questions and answers move. In a round of questions the packs' distinct keys go up a tree and answers come down
it. With radix r a pack sends r messages, one for each r-th of the keys; a node takes those of r packs for one range, merges
them and sends r messages on; after h hops, r to the h being as many as there are packs, a node has all that is known of its
range. So there are packs times r messages a hop, where r is FAN at most whatever the size, each node holds about
as much as a pack does, and a key that is in a third of all rows costs a node r entries, not one a pack.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .common import release, remember, remembered, shared_dir, sweep, tidy, worker_state, written
from .tokens import mix

#: Bytes of text in a pack (a longer text is a pack of its own), and of the packs that share a bucket, about.
PACK_BYTES, BUCKET_BYTES = 2 << 20, 64 << 20
#: Most messages that a pack or node sends, least hops of a message, and most buckets that Spark lets a table have.
FAN, LEAST_HOPS, MOST_BUCKETS = 256, 2, 100_000
#: Bits of a key that a message carries, besides those that its range tells.
BITS = 40

Messages = Iterator[tuple[int, bytes]]
Replies = dict[int, bytes]


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def arrays(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes; numbers of a column lie together, which compresses better."""
    return squeeze(len(columns[0]).to_bytes(8, "little") + b"".join([np.ascontiguousarray(c).tobytes() for c in columns]))


def columns(data: bytes, *types: str) -> list[np.ndarray]:
    data = expand(data)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for t in types:
        size = np.dtype(t).itemsize * n
        out.append(np.frombuffer(data, t, n, at))
        at += size
    return out


def bits(flags: np.ndarray) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expand(data), np.uint8), count=n).astype(bool)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(pa.RecordBatch.from_struct_array(pa.concat_arrays([batch.to_struct_array()])))
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


class Question:
    """What is asked about keys, and how it is answered on the way. Messages and answers are lists in the order of the
    children; an answer of None stands for one that holds nothing."""

    def up(self, messages: list[bytes], radix: int) -> list[tuple[int, bytes]]:
        """A node's messages as one for each part of its range."""
        raise NotImplementedError

    def top(self, messages: list[bytes]) -> list[bytes | None]:
        """Answers of a node that knows all about its range."""
        raise NotImplementedError

    def down(self, messages: list[bytes], replies: Replies, radix: int) -> list[bytes | None]:
        """Answers of a node from those to what it sent up."""
        raise NotImplementedError


def digits(key: np.ndarray, radix: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as fractions of their range: which part of it each is in, and the fraction of that part."""
    x = key * np.uint64(radix)
    return (x >> np.uint64(bits)).astype(np.int64), x & np.uint64((1 << bits) - 1)


def stretches(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of equal numbers."""
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist()):
        yield int(part[a]), slice(a, b)


def first_digits(h: np.ndarray, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit hashes, the range that a pack sends each to, and the key that it has there."""
    part, rest = digits(h >> np.uint64(16), radix, 48)
    return part, rest >> np.uint64(48 - BITS)


def by_part(h: np.ndarray, radix: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Of sorted hashes: the stretches that go to one range, and their keys there."""
    part, key = first_digits(h, radix)
    for p, at in stretches(part):
        yield p, at, key[at]


def keyed(key: np.ndarray, *values: np.ndarray) -> bytes:
    """A message of sorted keys with values. Keys are kept as differences, which are small where there are many."""
    step = np.diff(key, prepend=np.uint64(0))
    small = not len(step) or int(step.max()) < 1 << 32
    return bytes([small]) + arrays(step.astype(np.uint32) if small else step, *values)


def read_keyed(data: bytes, *types: str) -> list[np.ndarray]:
    step, *values = columns(data[1:], "<u4" if data[0] else "<u8", *types)
    return [np.cumsum(step, dtype=np.uint64), *values]


class KeyQuestion(Question):
    """Keys with columns of values. A group are the entries of a node that are equal in the key and the first columns;
    reduce() makes one entry of each, settle() its answer where all is known, entries() the answers of its entries."""

    types: tuple[str, ...] = ()
    same, order = 0, 0  # value columns that tell groups apart, and that sort entries
    flags = True

    def reduce(self, values: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
        raise NotImplementedError

    def settle(self, values: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def entries(self, answer: np.ndarray, group: np.ndarray, new: np.ndarray) -> np.ndarray:
        return answer[group]

    def write(self, answer: np.ndarray) -> bytes | None:
        return bits(answer) if answer.any() else None

    def read(self, data: bytes, n: int) -> np.ndarray:
        return flags(data, n)

    def nothing(self, n: int) -> np.ndarray:
        return np.zeros(n, bool)

    def _groups(self, messages: list[bytes]):
        own = [read_keyed(m, *self.types) for m in messages]
        key, *values = [np.concatenate([x[k] for x in own]) for k in range(1 + len(self.types))]
        order = np.lexsort((*reversed(values[: self.order]), key)) if self.order else np.argsort(key, kind="stable")
        key, values = key[order], [v[order] for v in values]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        for v in values[: self.same]:
            new[1:] |= v[1:] != v[:-1]
        return order, key, values, new, np.cumsum([len(x[0]) for x in own])

    def _split(self, answer: np.ndarray, order: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
        out = np.empty_like(answer)
        out[order] = answer
        return [self.write(x) for x in np.split(out, ends[:-1])]

    def up(self, messages: list[bytes], radix: int) -> list[tuple[int, bytes]]:
        _, key, values, new, _ = self._groups(messages)
        first = np.flatnonzero(new)
        part, rest = digits(key[first], radix)
        values = self.reduce(values, first)
        return [(p, keyed(rest[at], *[v[at] for v in values])) for p, at in stretches(part)]

    def top(self, messages: list[bytes]) -> list[bytes | None]:
        order, _, values, new, ends = self._groups(messages)
        answer = self.settle(values, np.flatnonzero(new))
        return self._split(self.entries(answer, np.cumsum(new) - 1, new), order, ends)

    def down(self, messages: list[bytes], replies: Replies, radix: int) -> list[bytes | None]:
        order, key, _, new, ends = self._groups(messages)
        first = np.flatnonzero(new)
        answer = self.nothing(len(first))
        for p, at in stretches(digits(key[first], radix)[0]):
            if p in replies:
                answer[at] = self.read(replies[p], at.stop - at.start)
        return self._split(self.entries(answer, np.cumsum(new) - 1, new), order, ends)


class Repeated(KeyQuestion):
    """Value: whether a pack has the key twice by itself. Answer: whether it is repeated at all."""

    types = ("?",)

    def reduce(self, values, first):
        return [self.settle(values, first)]

    def settle(self, values, first):
        return np.logical_or.reduceat(values[0], first) | (np.diff(np.append(first, len(values[0]))) > 1) if len(first) else np.zeros(0, bool)


class Firsts(KeyQuestion):
    """Values: the rest of a window's hash, id and place of its first occurrence. Answer: whether it isn't the first of all."""

    types, same, order = ("<u8", "<i8", "<i8"), 1, 3

    def reduce(self, values, first):
        return [v[first] for v in values]

    def settle(self, values, first):
        return np.zeros(len(first), bool)

    def entries(self, answer, group, new):
        return answer[group] | ~new


class Counts(KeyQuestion):
    """Value: how often a pack has a key, 255 at most. Answer: the sum over all packs, 255 at most; none where all are 1."""

    types = ("u1",)

    def reduce(self, values, first):
        return [self.settle(values, first)]

    def settle(self, values, first):
        return np.minimum(np.add.reduceat(values[0].astype(np.int64), first), 255).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)

    def write(self, answer):
        return squeeze(answer.tobytes()) if (answer > 1).any() else None

    def read(self, data, n):
        return np.frombuffer(expand(data), np.uint8, n)

    def nothing(self, n):
        return np.ones(n, np.uint8)


class Packs:
    """A table as packs, with exchanges over them. text: the column whose bytes bound a pack."""

    def __init__(self, df: DataFrame, text: str, name: str):
        self.schema, self.name, self.text = df.schema, name, text
        self.spark = spark = df.sparkSession

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state(None)
            first = TaskContext.get().partitionId() << 32
            for k, part in enumerate(slices(batches, text, PACK_BYTES)):
                data = to_ipc(part)
                yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([part.column(text).nbytes]), pa.array([data], pa.binary())], names=["pack", "bytes", "data"])

        before = remembered()
        loose = written(df.mapInArrow(pack, "pack long, bytes long, data binary"), f"{name}-packs")
        self.count, total = (x or 0 for x in loose.agg(F.count("*"), F.sum("bytes")).first())
        self.buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
        table, path = f"vexel_{uuid.uuid4().hex}", f"{shared_dir(spark).rstrip('/')}/vexel-{name}-bucketed-{uuid.uuid4().hex}"
        loose.select("pack", "data").repartition(self.buckets, "pack").write.bucketBy(self.buckets, "pack").option("path", path).option("compression", "none").saveAsTable(table)
        self.df = spark.table(table)
        del loose
        release(spark)
        sweep(spark, before)  # the table that they came from
        remember(path, table)
        self._tree()

    def _tree(self) -> None:
        self.hops = LEAST_HOPS
        while FAN**self.hops < self.count:
            self.hops += 1
        self.radix = max(2, math.ceil(self.count ** (1 / self.hops)))
        while self.radix**self.hops < self.count:
            self.radix += 1

    def groups(self, level: int) -> int:
        """How many groups of packs have nodes of their own at a level."""
        return max(1, -(-self.count // self.radix**level))

    def _over(self, df: DataFrame, answers: tuple[str, ...], fn, schema) -> DataFrame:
        """fn(record batch, pack, {part: answer} for each of answers) over all packs; it yields record batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_state(None)
            for batch in batches:
                for row in batch.to_pylist():
                    replies = [{x["part"]: x["answer"] for x in row[a] or []} for a in answers]
                    yield from fn(from_ipc(row["data"]), row["pack"], *replies)
            tidy()

        return df.mapInArrow(run, schema)

    def _with(self, *answers: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        """The packs with their answers, as many of each as the radix at most. Only answers are shuffled."""
        df, names = self.df, []
        for k, a in enumerate(answers):
            names.append(f"answers{k}")
            own = a.repartition(self.buckets, "pack").groupBy("pack").agg(F.collect_list(F.struct("part", "answer")).alias(names[-1]))
            df = df.join(own.hint("shuffle_hash"), "pack", "left")
        return df, tuple(names)

    def ask(self, fn: Callable[..., Messages], question: Question, label: str, *answers: DataFrame) -> DataFrame:
        """One round. fn(record batch, *earlier answers) yields (range, message). Gives the table (pack, part, answer), written
        to the shared folder; a lost executor repeats one round at most."""
        radix, hops, groups = self.radix, self.hops, [self.groups(k) for k in range(self.hops + 1)]
        count = max(1, self.count)

        def rows(a: list[int], b: list[int], data: list[bytes], names: list[str], kind=pa.int64()) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, kind), pa.array(data, pa.binary())], names=names)

        def send(batch: pa.RecordBatch, pack: int, *replies) -> Iterator[pa.RecordBatch]:
            got = list(fn(batch, *replies))
            if got:
                place = int(mix(np.array([pack], np.uint64), 90)[0] % np.uint64(count))
                yield rows([p * groups[1] + place // radix for p, _ in got], [pack] * len(got), [m for _, m in got], ["node", "child", "message"])

        def merge(level: int):
            def run(table: pa.Table) -> pa.Table:
                worker_state(None)
                table = table.sort_by("child")
                node = table.column("node")[0].as_py()
                part, group = divmod(node, groups[level])
                got = question.up(table.column("message").to_pylist(), radix)
                to = [(part * radix + d) * groups[level + 1] + group // radix for d, _ in got]
                return pa.Table.from_batches([rows(to, [node] * len(got), [m for _, m in got], ["node", "child", "message"])])

            return run

        def replies_of(table: pa.Table, level: int, out: list[bytes | None]) -> pa.Table:
            part = table.column("node")[0].as_py() // groups[level] % radix
            there = [(c, a) for c, a in zip(table.column("child").to_pylist(), out) if a is not None]
            return pa.Table.from_batches([rows([c for c, _ in there], [part] * len(there), [a for _, a in there], ["node", "part", "answer"], pa.int32())])

        def settle(table: pa.Table) -> pa.Table:
            worker_state(None)
            table = table.sort_by("child")
            return replies_of(table, hops, question.top(table.column("message").to_pylist()))

        def hand_down(level: int):
            def run(table: pa.Table, replies: pa.Table) -> pa.Table:
                worker_state(None)
                table = table.sort_by("child")
                known = dict(zip(replies.column("part").to_pylist(), replies.column("answer").to_pylist())) if replies.num_rows else {}
                return replies_of(table, level, question.down(table.column("message").to_pylist(), known, radix))

            return run

        df, names = self._with(*answers)
        asked, replied = "node long, child long, message binary", "node long, part int, answer binary"
        # repartition() stands here so that the way down finds the same exchange as the way up
        levels = [self._over(df, names, send, asked).repartition(self.buckets, "node")]
        for level in range(1, hops):
            levels.append(levels[-1].groupBy("node").applyInArrow(merge(level), asked).repartition(self.buckets, "node"))
        out = levels[-1].groupBy("node").applyInArrow(settle, replied)
        for level in range(hops - 1, 0, -1):
            out = levels[level - 1].groupBy("node").cogroup(out.repartition(self.buckets, "node").groupBy("node")).applyInArrow(hand_down(level), replied)
        said = written(out.withColumnRenamed("node", "pack"), f"{self.name}-{label}")
        del df, levels, out
        release(self.spark)  # the round's shuffles are of no more use
        return said

    def finish(self, fn: Callable[..., Iterator[pa.RecordBatch]], schema, *answers: DataFrame) -> DataFrame:
        """fn(record batch, *answers) over all packs; it yields record batches of the schema."""
        df, names = self._with(*answers)
        return self._over(df, names, lambda batch, pack, *replies: fn(batch, *replies), schema)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs. (Faster than numpy's unique on numbers that are mostly distinct.)"""
    h = np.sort(h)
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[edge], np.diff(np.append(edge, len(h)))


def answers_to(question: KeyQuestion, h: np.ndarray, radix: int, reply: Replies) -> np.ndarray:
    """For sorted distinct hashes, what was answered."""
    out = question.nothing(len(h))
    for p, at, _ in by_part(h, radix):
        if p in reply:
            out[at] = question.read(reply[p], at.stop - at.start)
    return out
