"""Operator 5: byte-level BPE encoding and decoding in linear time, by backtracking over the longest matches.

The merges are never replayed. In the result of greedy merging, any two neighbouring tokens are compatible: encoding
their bytes together gives the two tokens back. And a sequence whose neighbours are all compatible is that result. So
the encoder walks the text taking the longest token at each place, and falls back to the next shorter prefix, or a
token back, where the token isn't compatible with the one before. Whether two tokens are is found by undoing their
merges from the latest on, and remembered. Places from which the rest can't be encoded are marked and not tried again,
which keeps the walk linear. The longest token at every place comes from one pass of an Aho-Corasick automaton, which
takes strings: bytes become the Latin-1 characters of the same numbers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import list_array, slices
from .common import worker_state

#: Entries of the memories of a worker: of each of the two generations of pieces, and of pairs. A full generation takes the
#: older one's place, and pairs are emptied when full, so that no vocabulary of the data can fill a worker.
PIECES, PAIRS, LONGEST_PIECE = 150_000, 500_000, 48
#: Pieces of a text that are looked at together.
STRIDE = 1 << 17


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a line a token, its bytes in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Encoder:
    """Encodes and decodes by the ranks, which must have every single byte; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(x) for x in self.token]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for token, rank in ranks.items():
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) is not None), -1)
        self.halves = [(rank, rank) for rank in range(size)]  # what a token is merged from; a token that isn't is its own halves
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for rank in sorted(ranks.values()):
            left = self.shorter[rank]
            while left >= 0:
                right = ranks.get(self.token[rank][self.length[left] :])
                if right is not None and left < rank and right < rank and self._fits(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]

    def _fits(self, left: int, right: int) -> bool:
        """Undo the merges next to the border, the latest first; a merge across it that comes earlier would have won."""
        limit = len(self.token)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.halves[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def compatible(self, left: int, right: int) -> bool:
        known = self.known.get((left, right))
        if known is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            known = self.known[left, right] = self._fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length = len(piece), self.length
        longest = [0] * n
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # for one start, longer ones come later
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    break
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


class Pieces(dict):
    """For each piece met: its ids as the bytes of 32-bit numbers, and what they decode to."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, piece: str) -> tuple[bytes, bytes]:
        out = self.older.get(piece)
        if out is None:
            ids = self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass"))
            out = np.array(ids, dtype=np.int32).tobytes(), self.encoder.decode(ids)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


def of_worker(ranks: bytes) -> Pieces:
    """A Python worker keeps one vocabulary, and what it has encoded with it, from task to task."""
    return worker_state(("bpe", ranks), lambda: Pieces(Encoder(read_ranks(ranks))))


#: Unicode's white space, as the pattern's own engine has it; Python's \s also has 1C to 1F.
SPACE = r"\u0009-\u000D \u0085   -     　"


def compiled(pattern: str) -> regex.Pattern:
    inside = regex.sub(r"\[\^((?:[^\]\\]|\\.)*)\\s((?:[^\]\\]|\\.)*)\]", lambda m: f"[^{m[1]}{SPACE}{m[2]}]", pattern)
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, column: str = "text") -> DataFrame:
    """Adds ids (array of int) and decoded (binary: the bytes that the ids stand for) to every row.

    ranks: what a .tiktoken file holds; it goes to the executors with the function, a size fixed by the vocabulary.
    Every match of the pattern is encoded by itself; there are no special tokens. Null texts count as empty; empty
    texts have no ids and decode to nothing; very long texts are taken in strides. Other columns stay; those named ids
    or decoded are replaced. An empty table gives an empty result. Rows are independent: no shuffle.
    """
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = of_worker(ranks), compiled(pattern)
        get = pieces.__getitem__
        for batch in slices(batches, column):
            counts, ids, decoded = [], [], []
            for text in batch.column(names.index(column)).to_pylist():
                own, back = [], []
                matches = iter(split.findall(text or "")) if len(text or "") < 1 << 22 else (m[0] for m in split.finditer(text))
                while part := list(map(get, islice(matches, STRIDE))):
                    x, y = zip(*part)
                    own.append(b"".join(x))
                    back.append(b"".join(y))
                counts.append(sum(map(len, own)) // 4)
                ids += own
                decoded.append(b"".join(back))
            flat = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(np.array(counts), flat), pa.array(decoded, pa.binary())], names=[*names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def vocabulary(path: str) -> bytes:
    """The bytes of a vocabulary file on the driver."""
    with open(path, "rb") as f:
        return f.read()


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    return encoded.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_texts(docs, vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN), "doc_id")


