"""Operator 4: toxicity by maximum-scoring segments over token log-odds with Dirichlet priors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .common import written

#: Rows that the model is fitted on at most (drawn by a hash of the id).
MAX_LABELLED = 40_000
#: Strength of the prior in words; least z-score, of either sign, of a token whose log-odds count, and least log-odds of a toxic
#: one (words of a topic lean to either side a little); what every word costs a segment.
PRIOR, MIN_Z, MIN_RATIO, COST = 1000.0, 3.0, 1.5, 0.25
#: A passage is significant if a clean text of its length has one as good with at most this probability.
SIGNIFICANT = 0.01
#: Letters of the beginnings that stand in for a word that is itself too rare to count.
BEGINNINGS = (4, 5, 6)
#: What is taken off both ends of a word.
EDGES = b".,;:!?\"'()[]{}<>-_*"
REMEMBERED = 300_000


def features(word: bytes) -> list[str]:
    """What a word is looked up by: itself, and its beginnings with a star."""
    w = word.strip(EDGES).decode("utf-8", "replace").lower()
    return [w, *[f"{w[:n]}*" for n in BEGINNINGS if len(w) > n]] if w else []


def count_features(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(feature, n0, n1): how often texts of either label have it. Tasks count what they read first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words: tuple[Counter, Counter]) -> pa.RecordBatch:
            found: dict[str, list[int]] = {}
            for y in (0, 1):
                for w, n in words[y].items():
                    for f in features(w):
                        found.setdefault(f, [0, 0])[y] += n
            return pa.RecordBatch.from_arrays([pa.array([*found], pa.string()), *[pa.array([x[y] for x in found.values()], pa.int64()) for y in (0, 1)]], names=["feature", "n0", "n1"])

        words = Counter(), Counter()
        for batch in slices(batches, text):
            for t, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                words[bool(y)].update((t or b"").split())
            if len(words[0]) + len(words[1]) > REMEMBERED:
                yield rows(words)
                words = Counter(), Counter()
        yield rows(words)

    return docs.select(text, label).mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_odds(counts: DataFrame, prior: float = PRIOR, min_z: float = MIN_Z, min_ratio: float = MIN_RATIO) -> dict[str, float]:
    """Log-odds-ratio of each feature with an informative Dirichlet prior: its share of all counts times the prior's
    strength. Kept are toxic ones of min_ratio and clean ones of any, that are min_z deviations from 0 at least: their number
    has the bound that the labelled rows have."""
    total = counts.where(~F.col("feature").endswith("*")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1")).first()
    t0, t1 = float(total.t0 or 0), float(total.t1 or 0)
    if not t0 or not t1:
        return {}
    a = (F.col("n0") + F.col("n1")) * (prior / (t0 + t1))
    side = lambda n, t: F.log((F.col(n) + a) / F.greatest(F.lit(1.0), F.lit(t + prior) - F.col(n) - a))
    c = counts.withColumn("ratio", side("n1", t1) - side("n0", t0)).withColumn("z", F.col("ratio") / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a)))
    return {r.feature: r.ratio for r in c.where((F.abs("z") >= min_z) & ((F.col("ratio") < 0) | (F.col("ratio") >= min_ratio))).select("feature", "ratio").collect()}


class Words(dict):
    """The score of each word met: its log-odds, less the cost; 0 for a word that neither label has more than the other."""

    def __init__(self, ratios: dict[str, float], cost: float):
        super().__init__()
        self.ratios, self.cost = ratios, cost

    def __missing__(self, word: bytes) -> float:
        found = [self.ratios[f] for f in features(word) if f in self.ratios]
        out = (found[0] if found else 0.0) - self.cost
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text, in order, in time linear in its words (Ruzzo and Tompa).

    Only words with a positive score can begin or end one, so the scan goes over them; sums tell what lies between."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[list] = []  # start, end, sum before, sum up to the end, the last one before with a smaller sum before
    for p, left, right in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        new = [p, p + 1, left, right, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


class Calibration:
    """The largest segment score of n clean words is extreme-value distributed: P(S < x) = exp(-K n exp(-lambda x)).
    A passage's excess is lambda S - ln(K n): the probability of one as good in a clean text is about exp(-excess). A text's is
    the sum of those above 0 (better than the best that such a text has by itself), else the largest. A logistic curve over the excess, on a scale that is
    logarithmic away from 0, fitted on the labelled rows, turns it into a probability."""

    def __init__(self, rate: float = 1.0, log_k: float = 0.0, slope: float = 1.0, offset: float = 0.0):
        self.rate, self.log_k, self.slope, self.offset = rate, log_k, slope, offset

    def excess(self, scores: list[float], n: int) -> float:
        each = [self.rate * s - self.log_k - math.log(max(n, 1)) for s in scores] or [-self.log_k - math.log(max(n, 1))]
        above = [x for x in each if x > 0]
        return sum(above) if above else max(each)

    def probability(self, excess: float) -> float:
        z = self.slope * math.copysign(math.log1p(abs(excess)), excess) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(max(z, -700.0)) / (1 + math.exp(max(z, -700.0)))


def fit_calibration(rows: list[tuple[int, list[float], int]]) -> Calibration:
    """rows: label, segment scores, words. By moments for the distribution, by Newton's method for the curve."""
    out = Calibration()
    clean = np.array([(max(s, default=0.0), math.log(max(n, 1))) for y, s, n in rows if not y]).reshape(-1, 2)
    if len(clean) > 1:
        # with s = (ln K n + g) / lambda, g of Gumbel's law, lambda comes from the spread and K from the mean
        out.rate = math.pi / (math.sqrt(6) * max(float(clean[:, 0].std()), 0.05))
        out.log_k = float(out.rate * clean[:, 0].mean() - np.euler_gamma - clean[:, 1].mean())
    x = np.array([out.excess(s, n) for _, s, n in rows])
    y = np.array([y for y, _, _ in rows], float)
    if not len(x) or y.min() == y.max():
        out.slope, out.offset = 0.0, (-5.0 if not len(x) or not y.max() else 5.0)
        return out
    x = np.copysign(np.log1p(np.abs(x)), x)
    w = np.array([0.0, math.log(y.mean() / (1 - y.mean()))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        r = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - 1e-3 * w[0], (y - p).sum()])
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    out.slope, out.offset = max(0.0, float(w[0])), float(w[1])
    return out


def find_passages(docs: DataFrame, ratios: dict[str, float], text: str = "text", cost: float = COST) -> DataFrame:
    """Adds toxic_words (words of the text) and passages (first word, word after the last, score) to every row."""
    docs = docs.drop("toxic_words", "passages")
    passage = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_words", T.LongType()), T.StructField("passages", passage)])
    names, kind = docs.columns, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(ratios, cost)
        for batch in slices(batches, text):
            counts, found = [], []
            for t in batch.column(names.index(text)).cast(pa.binary()).to_pylist():
                own = (t or b"").split()
                counts.append(len(own))
                found.append([{"first": a, "end": b, "score": s} for a, b, s in segments(np.fromiter(map(words.__getitem__, own), float, len(own)))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind)], names=[*names, "toxic_words", "passages"])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], Calibration]:
    """docs (doc_id, text) and labels (doc_id, toxic). About max_labelled labelled rows at most take part, drawn by a hash
    of the id; so they can be broadcast, and what comes to the driver has that bound too."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if n > max_labelled:
        share = 1 << 20
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < int(share * max_labelled / n))
    labelled = written(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("toxic", "text"), "toxicity-labelled")
    ratios = log_odds(written(count_features(labelled, "text", "toxic"), "toxicity-counts"))
    rows = find_passages(labelled, ratios).select("toxic", "passages.score", "toxic_words").collect()
    return ratios, fit_calibration([(int(r[0] > 0), list(r[1]), r[2]) for r in rows])


def score_toxicity(docs: DataFrame, ratios: dict[str, float], calibration: Calibration, text: str = "text") -> DataFrame:
    """Adds toxic_words, passages (with whether each is significant), score (0 to 1) and predicted to every row.

    Scores use the text alone, all of it, however long. Null and empty texts have no words and no passages and get the
    score of a text of one clean word. Repeated rows get equal scores; an empty table gives an empty result; a model without
    ratios (no labels, or labels of one kind) gives all texts that kind's score. Other columns stay; those named like
    the added ones are replaced. No shuffle.
    """
    c = calibration
    docs = find_passages(docs.drop("score", "predicted"), ratios, text)
    base = F.lit(c.log_k) + F.log(F.greatest(F.col("toxic_words"), F.lit(1)))
    bound = -math.log(SIGNIFICANT)
    excess = lambda p: p.score * c.rate - base
    docs = docs.withColumn("passages", F.transform("passages", lambda p: F.struct(p.first.alias("first"), p.end.alias("end"), p.score.alias("score"), (excess(p) >= bound).alias("significant"))))
    each = F.transform("passages", excess)
    above = F.aggregate(F.filter(each, lambda x: x > 0), F.lit(0.0), lambda s, x: s + x)
    total = F.when(above > 0, above).otherwise(F.coalesce(F.array_max(each), -base))
    z = F.signum(total) * F.log1p(F.abs(total)) * c.slope + c.offset
    docs = docs.withColumn("score", F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z))))
    return docs.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    ratios, calibration = fit(docs, labels.where(~held))
    out = score_toxicity(docs.withColumn("held_out", held), ratios, calibration)
    return out.select("doc_id", "held_out", "score", "predicted", F.size(F.filter("passages", lambda p: p.significant)).cast("long").alias("n_passages"))
