"""Operator 3: repeated passages of words removed, found by level-wise doubling of the window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packs import Firsts, Messages, Packs, Repeated, Replies, answers_to, by_part, distinct, flags, keyed
from .tokens import Words, covered, fits, window_hashes

#: Words of a window, and of the windows that are looked at first.
WINDOW, FIRST = 20, 5


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """Lengths that double up to the window; the last one is the window, where it isn't a doubling."""
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


class View:
    """What a pack knows of its windows: their hashes at each level, and which are still candidates."""

    def __init__(self, batch: pa.RecordBatch, text: str, lengths: list[int]):
        self.batch, self.lengths = batch, lengths
        self.words = Words([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()])
        self.known: dict[int, np.ndarray] = {}
        self.h = self.words.hashes(0) if len(self.words) else np.zeros(0, np.uint64)

    def hashes(self, length: int) -> np.ndarray:
        return window_hashes(self.h, length, self.known)

    def candidates(self, level: int, radix: int, replies: tuple[Replies, ...]) -> np.ndarray:
        """Starts of the windows of this level that begin and end with a repeated one of the level before, at every level. Where
        a length is twice the one before, these are its halves; else they overlap."""
        at = np.flatnonzero(fits(self.words, self.lengths[0]))
        for k in range(level):
            h = self.hashes(self.lengths[k])[at]
            keys, _ = distinct(h)
            again = np.zeros(len(self.words), bool)
            again[at[answers_to(Repeated(), keys, radix, replies[k])[np.searchsorted(keys, h)]]] = True
            step = self.lengths[k + 1] - self.lengths[k]
            at = np.flatnonzero(again[:-step] & again[step:]) if len(again) > step else np.zeros(0, np.int64)
            fit = fits(self.words, self.lengths[k + 1])
            at = at[at < len(fit)]
            at = at[fit[at]]
        return at

    def firsts(self, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at these starts, grouped by all 128 bits of their hashes: the order, which of it begin a group, and the hashes in it."""
        length = self.lengths[-1]
        a = self.hashes(length)[at]
        b = window_hashes(self.words.hashes(1), length)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((at, ids[self.words.doc[at]], b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
        return order, new, a, b


def id_keys(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit numbers; null is the largest."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds n_words, n_removed, and kept (the text without its repeats, words joined by one space) to every row.

    A word goes if a window of so many words covers it whose words also start earlier: in a row with a smaller id, or
    earlier in the same one. Windows are taken from the input, not from what is left. Windows of the shortest level are
    asked for first; those repeated there are extended to twice the length, and only they are asked for again, up to
    the window itself, or until no candidate survives: a round without a repeated window ends it. Up to there a hash that
    is wrongly taken for repeated costs time alone; the window's own hash has 96 bits and more.

    Null and empty texts, and those shorter than the window, stay as they are (kept is empty for null). Null ids count
    as the largest id. Rows that share an id count as one document; of their windows that start at the same place, the
    first in the order of the packs stays, so of rows repeated whole one keeps its text. Very long texts are packs of
    their own. An empty table gives an empty result. Other columns stay; those named like the added ones are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    lengths = levels(window, first)
    packs = Packs(docs, text, "substrings")
    radix = packs.radix

    def ask_level(level: int):
        def send(batch: pa.RecordBatch, *replies) -> Messages:
            view = View(batch, text, lengths)
            h, times = distinct(view.hashes(lengths[level])[view.candidates(level, radix, replies)])
            for p, at, keys in by_part(h, radix):
                yield p, keyed(keys, times[at] > 1)

        return send

    def places(view: View, at: np.ndarray) -> np.ndarray:
        return at - view.words.first[view.words.doc[at]]

    def ask_first(batch: pa.RecordBatch, *replies) -> Messages:
        view, ids = View(batch, text, lengths), id_keys(batch.column(id_col))
        at = view.candidates(len(lengths) - 1, radix, replies)
        order, new, a, b = view.firsts(at, ids)
        at, a, b = at[order][new], a[new], b[new]
        place, doc = places(view, at), ids[view.words.doc[at]]
        for p, k, keys in by_part(a, radix):
            yield p, keyed(keys, b[k], doc[k], place[k])

    def finish(batch: pa.RecordBatch, *replies) -> Iterator[pa.RecordBatch]:
        view, ids = View(batch, text, lengths), id_keys(batch.column(id_col))
        at = view.candidates(len(lengths) - 1, radix, replies[:-1]) if survive else np.zeros(0, np.int64)
        order, new, a, _ = view.firsts(at, ids)
        gone = ~new
        heads = np.flatnonzero(new)
        for p, k, _ in by_part(a[heads], radix):
            if p in replies[-1]:
                gone[heads[k]] = flags(replies[-1][p], k.stop - k.start)
        words = view.words
        removed = covered(at[order][gone], window, len(words))
        n_removed = np.bincount(words.doc[removed], minlength=batch.num_rows)
        kept = pa.array(words.joined(~removed), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), kept], names=[*batch.schema.names, "n_words", "n_removed", "kept"])

    replies: list[DataFrame] = []
    survive = True
    for level in range(len(lengths) - 1):
        replies.append(packs.ask(ask_level(level), Repeated(), f"of-{lengths[level]}", *replies))
        survive = not replies[-1].isEmpty()
        if not survive:
            break
    if survive:
        replies.append(packs.ask(ask_first, Firsts(), "first", *replies))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return packs.finish(finish, schema, *replies)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1 : i + 20], ' ') ORDER BY doc_id, i) AS n FROM i JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM x WHERE n > 1),
a AS (SELECT doc_id, unnest(range(len(w))) AS k FROM d),
k AS (SELECT a.doc_id, array_to_string(list(d.w[a.k + 1] ORDER BY a.k), ' ') AS kept, count(*) AS n FROM a JOIN d USING (doc_id) ANTI JOIN g ON a.doc_id = g.doc_id AND a.k = g.k GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
