"""Operator 7: language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import slices
from .common import worker_state, written

#: Components of a vector, and the seed of the letters' vectors.
DIMENSIONS, SEED = 1024, 7
#: Languages whose prototypes come to the driver, and are compared with, at a time.
BLOCK = 4096
#: Vectors of n-grams that a worker keeps; emptied when full.
KEPT = 24_000
UNKNOWN = "und"


class Space:
    """Letters have random vectors of +1 and -1, drawn by seed and code point. The vector of a trigram binds its letters
    by multiplication, the first one rotated twice and the second one once, so that their order counts. A text, or a
    language, bundles its trigrams by addition. What is not a letter is one symbol, word edge."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.letter = np.zeros(0x110000, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                self.letter[k] = ord(c.lower()[0])
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.rows = np.zeros((0, dimensions), np.float32)

    def of_letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > KEPT:
                self.letters.clear()
            rng = np.random.Generator(np.random.Philox(key=self.seed << 32 | point))
            self.letters[point] = (rng.integers(0, 2, self.d, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[point]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Row numbers in self.rows for at most KEPT packed trigrams."""
        known = self.row
        new = [g for g in grams.tolist() if g not in known]
        if len(known) + len(new) > KEPT:
            known.clear()
            new = grams.tolist()
        if new:
            if not known:
                self.rows = np.zeros((KEPT, self.d), np.float32)
            first = len(known)
            for k in range(0, len(new), 512):
                part = new[k : k + 512]
                a, b, c = (np.array([self.of_letter(g >> s & 0x1FFFFF) for g in part]) for s in (42, 21, 0))
                self.rows[first + k : first + k + len(part)] = np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c
            known.update(zip(new, range(first, first + len(new))))
        return np.array([known[g] for g in grams.tolist()], np.int64)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, packed trigram, times), by text: trigrams around a letter, over whole texts."""
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        lengths = np.array([len(p) + 2 for p in points], np.int64)
        low = np.zeros(int(lengths.sum()), np.uint32)
        starts = np.cumsum(lengths) - lengths
        for p, s in zip(points, starts.tolist()):
            low[s + 1 : s + 1 + len(p)] = self.letter[p]
        owner = np.repeat(np.arange(len(texts)), lengths)
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0)  # a run of other characters is one edge
        low, owner = low[keep], owner[keep]
        there = np.zeros(0x110000, bool)
        there[low] = True
        alphabet = np.flatnonzero(there)
        code = np.zeros(0x110000, np.int64)
        code[alphabet] = np.arange(len(alphabet))
        k = len(alphabet)
        x = code[low]
        middle = np.flatnonzero(low[1:-1] != 0) + 1
        if not len(middle):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = ((owner[middle] * k + x[middle - 1]) * k + x[middle]) * k + x[middle + 1]
        key = np.sort(key.astype(np.uint32) if len(texts) * k**3 < 1 << 32 else key).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(edge, len(key)))
        key = key[edge]
        packed = alphabet[key // (k * k) % k] << 42 | alphabet[key // k % k] << 21 | alphabet[key % k]
        return key // k**3, packed, times

    def bundle(self, packed: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.zeros(self.d)
        for k in range(0, len(packed), KEPT):
            rows = self.vectors(packed[k : k + KEPT])
            out += times[k : k + KEPT].astype(np.float32) @ self.rows[rows]
        return out

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""
        owner, packed, times = self.grams(texts)
        out = np.zeros((len(texts), self.d))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        distinct = np.unique(packed)
        rows = self.vectors(distinct)[np.searchsorted(distinct, packed)] if len(distinct) <= KEPT else None
        for i in range(len(texts)):
            a, b = int(ends[i]), int(ends[i + 1])
            if b > a:
                out[i] = times[a:b].astype(np.float32) @ self.rows[rows[a:b]] if rows is not None else self.bundle(packed[a:b], times[a:b])
        return out


def of_worker(dimensions: int, seed: int) -> Space:
    """A Python worker keeps its space from task to task."""
    return worker_state(("langid", dimensions, seed), lambda: Space(dimensions, seed))


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(lang, v): the bundle of all texts of each language. Every task bundles what it reads and hands on one vector a language;
    their sums are the prototypes. Null texts and languages teach nothing; empty texts add nothing; repeated rows count as often
    as they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = of_worker(dimensions, seed), {}
        for batch in slices(batches, text):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            owner, packed, times = space.grams([x or "" for x in texts])
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[owner] if len(owner) else owner
            for k, name in enumerate(names):
                mine = which == k
                grams, at = np.unique(packed[mine], return_inverse=True)
                sums[name] = sums.get(name, 0) + space.bundle(grams, np.bincount(at, weights=times[mine], minlength=len(grams)))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums]), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(run, "lang string, v array<double>")
    return parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))


def prototypes(labelled: DataFrame, **how) -> dict[str, np.ndarray]:
    """profiles() on the driver, for few languages."""
    return {r.lang: np.array([x.x for x in r.v]) for r in profiles(labelled, **how).collect()}


def identify_by(docs: DataFrame, learned: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """identify() by a table of profiles(), however many: blocks of at most BLOCK languages, in the order of their names, are
    compared with in turn, and the best so far is carried along."""
    learned = written(learned, "languages")
    names, at = learned.select("lang").orderBy("lang"), None
    docs, left = docs.drop("lang_pred", "score"), True
    out = None
    while left:
        block = names.where(F.col("lang") > at) if at is not None else names
        found = sorted(r.lang for r in block.limit(BLOCK + 1).collect())
        left, found = len(found) > BLOCK, found[:BLOCK]
        rows = learned.where((F.col("lang") >= found[0]) & (F.col("lang") <= found[-1])).collect() if found else []
        mine = {r.lang: np.array([x.x for x in r.v]) for r in rows}
        if out is None:
            out = identify(docs, mine, text, dimensions, seed)
        else:
            before = [f"_before{k}" for k in range(2)]
            out = identify(out.withColumnsRenamed({"lang_pred": before[0], "score": before[1]}), mine, text, dimensions, seed)
            better = (F.col(before[0]) == UNKNOWN) | (F.col("score") > F.col(before[1]))
            out = out.withColumns({"lang_pred": F.when(better, F.col("lang_pred")).otherwise(F.col(before[0])), "score": F.greatest("score", before[1])}).drop(*before)
        at = found[-1] if found else None
    return out


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Adds lang_pred and score (the cosine with that language's prototype; below 0: 0) to every row.

    Texts without a letter, null and empty ones among them, get "und" and 0, as do all if nothing is learned. Whole
    texts are bundled. The first of equally near languages in the order of names wins; repeated rows get the same; an
    empty table gives an empty result. Other columns stay; those named like the added ones are replaced. No shuffle.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    names = docs.columns
    langs = sorted(k for k, v in learned.items() if np.any(v))
    unit = np.array([learned[k] / np.linalg.norm(learned[k]) for k in langs]).reshape(len(langs), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = of_worker(dimensions, seed)
        for batch in slices(batches, text):
            vectors = space.bundles([x or "" for x in batch.column(names.index(text)).to_pylist()])
            norms = np.linalg.norm(vectors, axis=1)
            pred, score = [UNKNOWN] * len(norms), np.zeros(len(norms))
            if langs:
                cosines = vectors @ unit.T / np.maximum(norms, 1e-300)[:, None]
                for i in np.flatnonzero(norms > 0).tolist():
                    best = int(np.argmax(cosines[i]))
                    pred[i], score[i] = langs[best], min(1.0, max(0.0, float(cosines[i, best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    learned = profiles(docs.where(~held))
    return identify_by(docs.select("doc_id", held.alias("held_out"), "text"), learned).drop("text")
