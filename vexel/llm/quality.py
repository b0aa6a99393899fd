"""Operator 6: quality rules by tokeniser fertility, with rejection bands per script."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .bpe import read_ranks, vocabulary
from .common import remembered, salted_join, sweep, worker_state, written

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: First and last code point of the blocks that tell a script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "semitic": [(0x590, 0x8FF)],
    "indic": [(0x900, 0xDFF)],
    "southeast": [(0xE00, 0x109F), (0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
NAMES = [*SCRIPTS, "other"]
#: By script: least and most characters per token, most byte-fallback share, least token entropy in bits of a text of FULL_TOKENS
#: tokens and more, least and most characters per token of the second vocabulary. They hold where labels are too few to fit any:
#: piece_bpe_32k has mostly Latin and Cyrillic pieces, other scripts fall back to bytes by nature, up to the one token
#: that begins a word. Prose keeps well above these entropies; shouted, looped and tabular junk uses few tokens.
BANDS = {
    "latin": (1.35, 8.0, 0.10, 6.1, 1.1, 9.0),
    "greek": (0.6, 6.0, 0.60, 4.5, 0.4, 8.0),
    "cyrillic": (1.0, 8.0, 0.15, 5.5, 0.5, 9.0),
    "semitic": (0.4, 6.0, 0.95, 3.5, 0.35, 8.0),
    "indic": (0.3, 6.0, 0.98, 3.0, 0.3, 8.0),
    "southeast": (0.25, 6.0, 0.995, 3.0, 0.25, 8.0),
    "hangul": (0.25, 4.0, 0.98, 3.5, 0.25, 5.0),
    "kana": (0.3, 4.0, 0.95, 3.5, 0.25, 5.0),
    "han": (0.25, 4.0, 0.995, 3.5, 0.25, 5.0),
    "other": (0.2, 8.0, 0.90, 3.0, 0.2, 9.0),
}
#: A short text can't show its entropy: the bound is lower by so many bits for each halving of its tokens below FULL_TOKENS.
FULL_TOKENS, BITS_A_HALVING = 1000, 0.28
#: Labelled good rows of a script that bands are fitted on at least; at most: all.
LEAST_LABELLED = 200
#: Share of a script's good rows that may lie beyond each fitted bound.
TAIL = 0.001
#: log2 of the token counts at which the fitted line of entropy against length may bend, where so many rows lie on both sides.
KNOTS, LEAST_BESIDE = (8.0, 10.0, 12.0), 20
#: What fitted bounds leave beyond the good rows: a share of their range of characters per token, and a byte-fallback share.
CHARS_SLACK, BYTE_SLACK = 0.25, 0.05
#: Cells that a pass of quantiles() cuts an interval into, and the type of which sums are exact, in whatever order.
CELLS, EXACT = 1024, "decimal(28,15)"
#: Words whose pieces a worker remembers; emptied when full.
REMEMBERED = 150_000

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("n_tokens", T.LongType()), ("chars_per_token", T.DoubleType()), ("byte_share", T.DoubleType()), ("token_entropy", T.DoubleType()), ("chars_per_bpe_token", T.DoubleType()), ("script", T.StringType()),
    ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
]


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of values that begin at starts, one after the other."""
    return values[np.arange(int(lengths.sum())) + np.repeat(starts - starts_of(lengths), lengths)]


def repeat_words(codes: np.ndarray, n_codes: int) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(codes) < 4:
        return 0
    codes = codes.astype(np.int64)
    if n_codes < 1 << 21:
        key = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    else:  # too many words to pack three of them: number the pairs first
        _, pairs = np.unique(codes[:-2] * n_codes + codes[1:-1], return_inverse=True)
        key = pairs * n_codes + codes[2:]
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at, covered = order[twice], np.zeros(len(codes), bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        else:
            seen.add(line)
    return n


class Vocabularies(NamedTuple):
    """What the files hold: a sentencepiece model with byte fallback, and the ranks and pattern of a byte-level one."""

    pieces: bytes
    ranks: bytes
    pattern: str


class Fertility:
    """Pieces of words by two public vocabularies: their numbers, and what the texts made of them measure."""

    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.pieces)
        self.bpe = tiktoken.Encoding("second", pat_str=vocabularies.pattern, mergeable_ranks=read_ranks(vocabularies.ranks), special_tokens={})
        self.n_ids = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.n_ids)])
        self.known: dict[bytes, tuple[bytes, int, int, int]] = {}
        ends = sorted((a, b, k) for k, s in enumerate(SCRIPTS) for a, b in SCRIPTS[s])
        self.first, self.last, self.kind = (np.array(x) for x in zip(*ends))

    def script(self, word: str) -> int:
        """The script of a word's first letter; -1 without one."""
        for c in word:
            if c.isalpha():
                at = int(np.searchsorted(self.first, ord(c), side="right")) - 1
                return int(self.kind[at]) if at >= 0 and ord(c) <= self.last[at] else len(SCRIPTS)
        return -1

    def words(self, vocab: list[bytes]) -> list[tuple[bytes, int, int, int]]:
        """For each word: its ids as the bytes of 32-bit numbers, its code points, its script, its tokens (after a space) by the
        second vocabulary."""
        known = self.known
        new = [w for w in vocab if w not in known]
        texts = [w.decode("utf-8", "replace") for w in new]
        for w, t, ids in zip(new, texts, self.model.encode(texts, num_threads=1) if texts else []):
            known[w] = np.array(ids, np.int32).tobytes(), len(t), self.script(t), len(self.bpe.encode_ordinary(f" {t}"))
        out = [known[w] for w in vocab]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def measure(self, texts: list[bytes]) -> list[np.ndarray]:
        """The columns of FIELDS but the last two, script as a number before the second vocabulary's measure."""
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        codes, counts = [], []
        for text in texts:
            own = text.split()
            counts.append(len(own))
            codes.append(np.array([number(w, len(numbers)) for w in own], np.int64))
        n_docs, counts = len(texts), np.array(counts, np.int64)
        info = self.words(list(numbers))
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(n_docs), counts)
        by_doc = lambda values: np.bincount(doc, weights=values[code] if len(code) else None, minlength=n_docs)
        chars = np.array([x[1] for x in info], np.int64)
        word_chars = by_doc(chars).astype(np.int64) if len(code) else np.zeros(n_docs, np.int64)
        seconds = by_doc(np.array([x[3] for x in info], np.int64)) if len(code) else np.zeros(n_docs)
        lengths = np.array([len(x[0]) // 4 for x in info], np.int64)
        flat = np.frombuffer(b"".join([x[0] for x in info]), np.int32)
        n = lengths[code] if len(code) else np.zeros(0, np.int64)
        ids = gather(flat, starts_of(lengths)[code], n) if len(code) else np.zeros(0, np.int32)
        at = np.repeat(doc, n)
        n_tokens = np.bincount(at, minlength=n_docs)
        n_bytes = np.bincount(at, weights=self.is_byte[ids], minlength=n_docs) if len(ids) else np.zeros(n_docs)
        key = np.sort(at * self.n_ids + ids)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(key)))
        owner = key[edge] // self.n_ids
        total = np.maximum(n_tokens, 1)
        share = times / total[owner]
        entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=n_docs) if len(edge) else np.zeros(n_docs)
        script = np.full(n_docs, len(SCRIPTS))
        kinds = np.array([x[2] for x in info], np.int64)
        if len(code):
            lettered = kinds[code] >= 0
            votes = np.bincount(doc[lettered] * len(NAMES) + kinds[code][lettered], weights=chars[code][lettered], minlength=n_docs * len(NAMES)).reshape(n_docs, -1)
            script = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), script)
        symbols = np.array([sum(text.count(c) for c in SYMBOLS) for text in texts], np.int64)
        lines = np.array([dup_lines(text) for text in texts], np.int64)
        again = np.array([repeat_words(c, len(numbers)) for c in codes], np.int64)
        return [counts, word_chars, symbols, lines, again, n_tokens.astype(np.int64), word_chars / total, n_bytes / total, np.maximum(entropy, 0.0), script, word_chars / np.maximum(seconds, 1)]


def of_worker(vocabularies: Vocabularies) -> Fertility:
    """A Python worker keeps the models, and the words it has met, from task to task."""
    return worker_state(("quality", *vocabularies), lambda: Fertility(vocabularies))


Bands = dict[str, tuple[float, float, float, float, float, float]]
#: By script: log2 of token counts, and the least entropy at each; lines between them, level beyond the last.
Floors = dict[str, tuple[list[float], list[float]]]


def log2_tokens() -> Column:
    return F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))


def fit_lines(good: DataFrame) -> dict[str, tuple[list[float], np.ndarray, float]]:
    """For each script with rows enough: the bends of its line of entropy against log2 of the tokens, the line's coefficients by least
    squares, and log2 of the most tokens. All rows count, by sums that are exact, so the line is the same in every run."""
    x, bits = log2_tokens(), F.col("token_entropy")
    basis = [F.lit(1.0), x, *[F.greatest(F.lit(0.0), x - k) for k in KNOTS]]
    pairs = list(combinations_with_replacement(range(len(basis)), 2))
    total = lambda c: F.sum(c.cast(EXACT)).cast("double")
    rows = good.groupBy("script").agg(
        F.count("*").alias("n"),
        F.max(x).alias("top"),
        F.array(*[F.least(F.count_if(F.col("n_tokens") < int(2**k)), F.count_if(F.col("n_tokens") > int(2**k))) for k in KNOTS]).alias("beside"),
        F.array(*[total(basis[i] * basis[j]) for i, j in pairs]).alias("squares"),
        F.array(*[total(b * bits) for b in basis]).alias("products"),
    )
    out = {}
    for r in rows.where(F.col("n") >= LEAST_LABELLED).collect():
        own = [0, 1, *[2 + i for i, n in enumerate(r.beside) if n >= LEAST_BESIDE]]
        at = {p: v for p, v in zip(pairs, r.squares)}
        squares = np.array([[at[min(i, j), max(i, j)] for j in own] for i in own])
        line = np.linalg.lstsq(squares, np.array(r.products)[own], rcond=None)[0]
        out[r.script] = [KNOTS[i - 2] for i in own[2:]], line, r.top
    return out


def quantiles(values: DataFrame, shares: dict[str, list[float]]) -> dict[tuple[str, str], list[float]]:
    """values (script, name, value): for each script and name the quantiles that shares asks for, between the two values next to each, of all
    values. They are counted by cells of the interval that holds them, then by cells of those cells that hold a wanted rank, until
    these have one value. So they are exact, and a pass brings CELLS rows at most for each interval to the driver, whatever the rows."""
    found, counts = {}, {}
    todo: dict[tuple, list[tuple[int, int]]] = {}  # script, name, least and greatest value: ranks, in this interval and of all
    for script, name, n, low, high in values.groupBy("script", "name").agg(F.count("*"), F.min("value"), F.max("value")).collect():
        counts[script, name] = n
        ranks = {k for s in shares[name] for k in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
        todo[script, name, low, high] = [(k, k) for k in ranks]
    while True:
        for script, name, low, high in [x for x in todo if x[2] == x[3]]:
            found |= {(script, name, rank): low for _, rank in todo.pop((script, name, low, high))}
        if not todo:
            break
        intervals = list(todo)
        table = values.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(intervals)], "interval int, script string, name string, low double, high double")
        inside = values.join(F.broadcast(table), ["script", "name"]).where("value BETWEEN low AND high")
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS))
        cells = defaultdict(list)
        for i, *x in inside.groupBy("interval", cell.alias("cell")).agg(F.count("*"), F.min("value"), F.max("value")).collect():
            cells[i].append(x)
        narrower = defaultdict(list)
        for i, (script, name, *_) in enumerate(intervals):
            own = sorted(cells[i])
            ends = np.cumsum([n for _, n, *_ in own])
            for k, rank in todo[intervals[i]]:
                at = int(np.searchsorted(ends, k, side="right"))
                narrower[script, name, own[at][2], own[at][3]].append((k - int(ends[at]) + own[at][1], rank))
        todo = dict(narrower)

    def between(script: str, name: str, share: float) -> float:
        at = share * (counts[script, name] - 1)
        low, high = found[script, name, math.floor(at)], found[script, name, math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    return {(script, name): [between(script, name, s) for s in shares[name]] for script, name in counts}


def around(low: float, high: float) -> tuple[float, float]:
    """A band about two quantiles, with some slack."""
    slack = CHARS_SLACK * (high - low)
    return low - slack, high + slack


def good_ids(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality): the ids whose lowest label is above 0, once each."""
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality > 0").select("doc_id")


def bands_of(rows: DataFrame, labels: DataFrame) -> tuple[Bands, Floors]:
    """rows of measured(), with doc_id, and labels (doc_id, quality): bands, and entropy floors, for verdicts().

    All labelled rows take part; an id's lowest label and one of its rows count. Bounds are quantiles of the good rows
    (quality above 0) that pass the base rules, by script; scripts with fewer than LEAST_LABELLED of them keep the fixed
    bands. Entropy has a line with bends against log2 of the tokens instead, lowered until a share of TAIL lies below it; it goes on
    as it begins for texts shorter than all of these, and stays level for longer ones."""
    spark, before = rows.sparkSession, remembered()
    measures = "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "chars_per_bpe_token"
    own = rows.where("NOT base_failed AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*measures)).alias("m"))
    good = written(own.join(good_ids(labels), "doc_id").select("m.*"), "quality-good")
    lines = fit_lines(good)
    bands, floors = dict(BANDS), {}
    if lines:
        x, above = log2_tokens(), F.lit(None).cast("double")
        for script, (knots, line, _) in lines.items():
            height = sum((F.greatest(F.lit(0.0), x - k) * float(c) for k, c in zip(knots, line[2:])), x * float(line[1]) + float(line[0]))
            above = F.when(F.col("script") == script, F.col("token_entropy") - height).otherwise(above)
        named = {"chars": F.col("chars_per_token"), "bytes": F.col("byte_share"), "second": F.col("chars_per_bpe_token"), "above": above}
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), c.alias("value")) for k, c in named.items()])).alias("v")
        found = quantiles(
            good.where(F.col("script").isin(*lines)).select("script", each).select("script", "v.*"),
            {"chars": [TAIL, 1 - TAIL], "bytes": [1 - TAIL], "second": [TAIL, 1 - TAIL], "above": [TAIL]},
        )
        for script, (knots, line, top) in lines.items():
            at = np.array([0.0, *knots, top])
            height = np.column_stack([np.ones(len(at)), at, *[np.maximum(0.0, at - k) for k in knots]]) @ line
            floors[script] = at.tolist(), (height + found[script, "above"][0]).tolist()
            most = min(BANDS[script][2], found[script, "bytes"][0] + BYTE_SLACK)
            bands[script] = (*around(*found[script, "chars"]), most, floors[script][1][-1], *around(*found[script, "second"]))
    sweep(spark, before)
    return bands, floors


def fit_bands(docs: DataFrame, labels: DataFrame, vocabularies: Vocabularies) -> tuple[Bands, Floors]:
    """docs (doc_id, text) and labels (doc_id, quality): bands, and entropy floors, for score_quality(), of all labelled rows
    (see bands_of()). The texts meet the labels in a shuffle, at any size; those that none calls good are not measured."""
    good = salted_join(docs.select("doc_id", "text"), good_ids(labels).hint("merge"), "doc_id", "text")
    return bands_of(measured(good, vocabularies), labels)


def measured(docs: DataFrame, vocabularies: Vocabularies, column: str = "text") -> DataFrame:
    """Adds the columns of FIELDS but the last, kept, to every row; see score_quality()."""
    docs = docs.drop(*[n for n, _ in FIELDS])
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t, False) for n, t in FIELDS[:-1]]])
    added = pa.schema([("n", pa.int64())] * 6 + [("x", pa.float64())] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = of_worker(vocabularies)
        for batch in slices(batches, column):
            texts = [x or b"" for x in batch.column(names.index(column)).cast(pa.binary()).to_pylist()]
            found = fertility.measure(texts)
            n_words, again, script = found[0], found[4], found[9]
            failed = (n_words < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n_words)
            own = [pa.array(x, t) for x, t in zip([*found[:9], found[10]], added.types)]
            own += [pa.array([NAMES[k] for k in script], pa.string()), pa.array(failed)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*names, *[n for n, _ in FIELDS[:-1]]])

    return docs.mapInArrow(run, schema)


def entropy_floor(script: str, bands: Bands, floors: Floors) -> Column:
    """The least token entropy of a text of the script, by its tokens."""
    x = log2_tokens()
    if script not in floors:
        return bands[script][3] - BITS_A_HALVING * F.greatest(F.lit(0.0), math.log2(FULL_TOKENS) - x)
    at, bits = floors[script]
    out = F.lit(bits[-1])
    for k in reversed(range(len(at) - 1)):
        if at[k] < at[k + 1]:
            out = F.when(x < at[k + 1], (x - at[k]) * ((bits[k + 1] - bits[k]) / (at[k + 1] - at[k])) + bits[k]).otherwise(out)
    return out


def verdicts(rows: DataFrame, bands: Bands = BANDS, floors: Floors | None = None) -> DataFrame:
    """Adds kept to rows of measured()."""
    fine = F.lit(False)
    for script in NAMES:
        low, high, most, _, low2, high2 = bands[script]
        own = F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= most) & F.col("chars_per_bpe_token").between(low2, high2)
        fine = F.when(F.col("script") == script, own & (F.col("token_entropy") >= entropy_floor(script, bands, floors or {}))).otherwise(fine)
    return rows.select("*", (~F.col("base_failed") & fine).alias("kept"))


def score_quality(
    docs: DataFrame, vocabularies: Vocabularies, column: str = "text", bands: Bands = BANDS, floors: Floors | None = None
) -> DataFrame:
    """Adds the columns of FIELDS to every row: counts, what the tokeniser measures, base_failed and kept.

    Words are encoded one by one, by both vocabularies. A document is kept if it passes the base rules (words enough,
    repeats not too many) and its script's bands for characters per token of either, byte-fallback share and token entropy
    of the first (see BITS_A_HALVING; floors of a script take its place). Its script is the one with most letters (by the words' first letters),
    "other" if it has none. Null and empty texts have no words and fail the base rules. Whole texts are measured,
    however long; rows are independent: repeated ones get the same result; an empty table gives an empty one. Other
    columns stay; those named like the added ones are replaced. No shuffle.
    """
    return verdicts(measured(docs, vocabularies, column), bands, floors)


def vocabularies() -> Vocabularies:
    import public_tokenizers

    return Vocabularies(vocabulary(public_tokenizers.path("piece_bpe_32k.model")), vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def held_out() -> Column:
    """Rows that no bands of labelled() are fitted on."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels (doc_id, quality), but for a fifth that is held out."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs scored by bands that are fitted on their labelled rows. Texts that a label calls good are measured twice, and none are written."""
    models = vocabularies()
    bands, floors = fit_bands(docs, labelled(spark, sf_dir), models)
    return score_quality(docs, models, bands=bands, floors=floors)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fitted(), without texts: what each row measures is written once, and bands and verdicts come from that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = written(measured(docs, vocabularies()).drop("text"), "quality-measured")
    return verdicts(rows, *bands_of(rows, labelled(spark, sf_dir)))
