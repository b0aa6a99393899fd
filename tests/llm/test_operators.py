"""The training-data operators against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from vexel.llm import bpe, common, graph, jaccard, langid, mixing, packs, quality, sharding, substrings, suffixes, tokens, topk, toxicity  # noqa: E402
from vexel.llm import queries as llm  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and very long texts, characters of up to four bytes, zero bytes."""
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["é", "ß", "日本", "😀", "A", "a"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(30)
    out, n = [], 0

    def add(t, source="hot"):
        nonlocal n
        out.append((n, t, rnd.choice(["en", "de", None]), source, None if t is None else len(t)))
        n += 1

    base = text(120)
    for k in range(12):
        add(base)
    for k in range(30):
        w = base.split()
        w[rnd.randrange(len(w))] = f"x{k}"
        add(" ".join(w))
    for k in range(25):
        add(f"{text(40)} {passage}\n{text(30)}", f"s{k % 3}")
    for t in (None, "", " \n\t", "one", "One", "two words", "TWO words", "a b c d", "a b c d e", "same " * 200, "\0" * 120, "é" * 100, text(20_000), text(20_000)[:-1] + "\0", passage, f" {passage}  "):
        add(t, None)
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


PAIRS = [(r[0], r[1]) for r in awkward()]


def small_packs(monkeypatch, size=20_000):
    monkeypatch.setattr(packs, "PACK_BYTES", size)


# --- 1


def vectors(rows, spark):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, weights string, rank int")
    path = f"{common.shared_dir(spark)}/vectors-{random.random()}"
    df.write.parquet(f"{path}/embeddings.parquet")
    return topk.op1_topk(spark, path)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 40)
    rnd = np.random.default_rng(1)
    data = [(i, [float(np.float32(x)) for x in rnd.normal(size=8).round(1)]) for i in range(260)]
    data += [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []), (550, [1.0, 2.0]), (0, data[0][1]), (7, data[7][1]), (None, [0.5] * 8)]
    got = vectors([(i, v, "x", "y", 0) for i, v in data], spark).collect()
    want = brute.top_k([(i if i is not None else -1, v) for i, v in data])
    plain = lambda rows: sorted((q, s) for q, _, _, s in rows)
    assert plain(map(tuple, got)) == plain(want)
    assert [tuple(r) for r in sorted(got) if r.query_id == 100] == [x for x in want if x[0] == 100]


def test_top_k_few(spark):
    assert vectors([], spark).count() == 0
    assert vectors([(0, [1.0], "", "", 0)], spark).count() == 0
    assert vectors([(0, [1.0], "", "", 0), (1, [2.0], "", "", 0)], spark).collect() == [(0, 1, 1, 131072)]


# --- 2


def test_sharding(spark, docs):
    rows = sharding.assign_shards(docs.withColumn("slot", F.lit("x")).withColumn("_key", F.lit(1)), n_shards=7).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == len(PAIRS) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    total = Counter(r.source for r in rows)
    for source in total:
        each = [sum(r.source == source for r in rows if r.shard == s) for s in range(7)]
        assert max(each) - min(each) <= 2
    again = sharding.assign_shards(docs.repartition(5), n_shards=7).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in again} == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_sharding_edges(spark, empty, docs):
    assert sharding.assign_shards(empty).count() == 0
    few = sharding.assign_shards(docs.limit(3), n_shards=40).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    same = sharding.assign_shards(docs.limit(1).union(docs.limit(1)).withColumn("doc_id", F.lit(None).cast("long")), n_shards=2).collect()
    assert sorted(r.shard for r in same) == [0, 1]


def copies_and_lost_ids(spark):
    """A third of the rows copies of one row, a third without an id, in a column layout that clashes."""
    rows = [(1, "same text", "en", "hot", 9)] * 300 + [(None, f"text {k}", "en", "hot", 9) for k in range(300)] + [(k, f"other {k}", None, f"s{k % 3}", 9) for k in range(300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_copies_and_lost_ids_spread_over_the_ranges(spark, monkeypatch):
    df = copies_and_lost_ids(spark)
    numbered = common.ordinals(common.numbered(df.withColumn("same", F.concat_ws(":", "doc_id", "text")), "test", "row"), "same", "row", "nth")
    assert sorted(r.nth for r in numbered.where("doc_id = 1 and text = 'same text'").collect()) == list(range(300))
    seen = []
    monkeypatch.setattr(sharding, "running", lambda d, g, b, *a, **k: (seen.append(d.groupBy(*g, b).count().agg(F.max("count")).first()[0]), common.running(d, g, b, *a, **k))[1])
    rows = sharding.assign_shards(df, n_shards=9).collect()
    assert max(seen) < 12  # rows that meet in one task, of 900
    for r in (rows, sharding.assign_shards(df.repartition(7), n_shards=9).collect()):
        assert sorted((x.shard, x.slot) for x in r) == [(k, i) for k in range(9) for i in range(100)]
    assert max(Counter(r.shard for r in rows if r.text == "same text").values()) <= 50
    digest = lambda rs: sorted((x.shard, x.slot, x.doc_id or -1, x.text) for x in rs)
    assert digest(rows) == digest(r)
    mixed = [sorted((x.doc_id or -1, x.text, x.copies, x.taken, x.start) for x in mixing.mix(d).collect()) for d in (df, df.repartition(7))]
    assert mixed[0] == mixed[1]


def test_sharding_query(spark, duck):
    got = llm.QUERIES["op2_sharding"](spark, SF).collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(got) == len(texts)
    for r in got:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, brute.crc(texts[r.doc_id]))


# --- 3


@pytest.mark.parametrize("first", [5, 10, 20])
def test_substrings(docs, monkeypatch, first):
    small_packs(monkeypatch)
    got = substrings.remove_repeats(docs.withColumn("kept", F.lit(1)).withColumn("N_WORDS", F.lit(2)), first=first).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in got} == brute.substrings(PAIRS)


@pytest.mark.parametrize("window", [3, 7, 25])
def test_windows_that_do_not_halve(docs, monkeypatch, window):
    small_packs(monkeypatch)
    got = substrings.remove_repeats(docs, window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in got} == brute.substrings(PAIRS, window)


def test_rounds_end_where_no_candidate_survives(spark, monkeypatch):
    asked, ask = [], packs.Packs.ask
    monkeypatch.setattr(packs.Packs, "ask", lambda self, fn, q, label, *a: (asked.append(label), ask(self, fn, q, label, *a))[1])
    run = lambda texts: substrings.remove_repeats(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)).agg(F.sum("n_removed")).first()[0]
    words = [f"w{k}" for k in range(100)]
    assert run([" ".join(words[:40]), " ".join(words[50:90])]) == 0 and asked == ["of-5"]
    asked.clear()
    assert run([" ".join(words[:40]), " ".join(["x", *words[:8], "y"])]) == 0 and asked == ["of-5", "of-10"]
    asked.clear()
    assert run([" ".join(words[:40]), " ".join(words[10:35])]) == 25 and asked == ["of-5", "of-10", "first"]


def test_substrings_edges(docs, empty):
    assert substrings.remove_repeats(empty).count() == 0
    assert substrings.levels(20, 5) == [5, 10, 20] and substrings.levels(25) == [5, 10, 20, 25] and substrings.levels(3) == [3]
    # equal rows with one id, and with none: one of them keeps its words
    one = docs.where("doc_id = 0")
    for df in (one.union(one), one.union(one).withColumn("doc_id", F.lit(None).cast("long"))):
        kept = sorted(len(r.kept) for r in substrings.remove_repeats(df).collect())
        assert kept == [0, len(PAIRS[[p[0] for p in PAIRS].index(0)][1])]


# --- 4


def test_segments():
    def slow(scores):
        found = []
        while True:
            best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if all(not (a < y and x < b) for x, y in found)), key=lambda t: (t[0], t[1] - t[2]), default=(0, 0, 0))
            if best[0] <= 0:
                return sorted(found)
            found.append((best[1], best[2]))

    rnd = random.Random(2)
    for _ in range(200):
        s = [rnd.choice([-3, -2, -1, 1, 2, 4]) + rnd.random() * 1e-3 for _ in range(rnd.randrange(0, 14))]
        assert sorted((a, b) for a, b, _ in toxicity.segments(np.array(s, float))) == slow(s)


def test_toxicity_is_that_of_the_plain_way(spark):
    """Counts, log-odds, segments by trying all, calibration and score, one document after the other."""
    import math

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs |= {10_000: None, 10_001: "", 10_002: docs[min(docs)]}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    df = spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string").repartition(3)
    ratios, c = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    n = {0: Counter(), 1: Counter()}
    for i, y in labels:
        for w in (docs[i] or "").encode().split():
            n[y].update(toxicity.features(w))
    t = {y: sum(v for f, v in n[y].items() if not f.endswith("*")) for y in (0, 1)}
    want = {}
    for f in {*n[0], *n[1]}:
        a = (n[0][f] + n[1][f]) * toxicity.PRIOR / (t[0] + t[1])
        odds = [math.log((n[y][f] + a) / max(1.0, t[y] + toxicity.PRIOR - n[y][f] - a)) for y in (0, 1)]
        ratio = odds[1] - odds[0]
        if abs(ratio / math.sqrt(1 / (n[1][f] + a) + 1 / (n[0][f] + a))) >= toxicity.MIN_Z and (ratio < 0 or ratio >= toxicity.MIN_RATIO):
            want[f] = ratio
    assert set(want) == set(ratios) and all(ratios[f] == pytest.approx(r) for f, r in want.items()) and min(want.values()) < 0

    def best_segments(s, a, b):
        """The best stretch, and those to its left and right."""
        sums = np.concatenate(([0.0], np.cumsum(s[a:b])))
        gain = sums[1:] - np.minimum.accumulate(sums[:-1]) if b > a else np.zeros(0)
        if not len(gain) or gain.max() <= 1e-12:
            return []
        end = int(gain.argmax()) + 1
        start = int(np.flatnonzero(sums[:end] <= sums[:end].min() + 1e-12)[-1])
        return best_segments(s, a, a + start) + [sums[end] - sums[start]] + best_segments(s, a + end, b)

    for r in toxicity.score_toxicity(df, ratios, c).collect():
        own = (docs[r.doc_id] or "").encode().split()
        s = np.array([next((want[f] for f in toxicity.features(w) if f in want), 0.0) - toxicity.COST for w in own])
        each = [x * c.rate - c.log_k - math.log(max(1, len(own))) for x in best_segments(s, 0, len(s))]
        assert len(r.passages) == len(each) and sum(p.significant for p in r.passages) == sum(x >= -math.log(toxicity.SIGNIFICANT) for x in each)
        total = sum(x for x in each if x > 0) or max(each, default=-c.log_k - math.log(max(1, len(own))))
        z = math.copysign(math.log1p(abs(total)), total) * c.slope + c.offset
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_toxicity_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = llm.QUERIES["op4_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for train, y in ((docs, labels), (empty, labels), (docs, labels.limit(0))):
        ratios, calibration = toxicity.fit(train, y)
        out = toxicity.score_toxicity(docs.withColumn("score", F.lit("x")).withColumn("passages", F.lit(1)), ratios, calibration).collect()
        assert len(out) == len(PAIRS) and all(0 <= r.score <= 1 for r in out)
        assert toxicity.score_toxicity(empty, ratios, calibration).count() == 0


# --- 5


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def test_bpe_is_tiktoken(docs, empty, vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    for r in bpe.encode_texts(docs.withColumn("ids", F.lit(1)), ranks, pattern).collect():
        assert r.ids == want.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_texts(empty, ranks, pattern).count() == 0


def test_bpe_on_odd_characters(vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    table = bpe.read_ranks(ranks)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    encoder, split, rnd = bpe.Encoder(table), bpe.compiled(pattern), random.Random(3)
    alphabet = "abc déñ  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　'stllve0٣½!?.\U0001f600​﻿<|endoftext|>"
    for _ in range(3000):
        s = "".join(rnd.choice(alphabet) if rnd.random() < 0.9 else chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x20000)])) for _ in range(rnd.randrange(1, 60)))
        assert [i for m in split.findall(s) for i in encoder.encode_piece(m.encode())] == want.encode_ordinary(s)


def test_pieces_are_remembered_and_forgotten(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    pieces = bpe.Pieces(bpe.Encoder(bpe.read_ranks(vocabulary[0])))
    for w in " alpha beta gamma delta alpha beta epsilon zeta eta theta alpha".split(" ") * 3:
        assert pieces[w][1] == w.encode() and len(pieces) <= 3 and len(pieces.older) <= 3


def test_bpe_is_linear(vocabulary):
    import time

    import tiktoken

    table = bpe.read_ranks(vocabulary[0])
    encoder, want = bpe.Encoder(table), tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=table, special_tokens={})
    rnd = random.Random(4)
    piece = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    some = piece(20_000)
    assert encoder.encode_piece(some.encode()) == want.encode_ordinary(some)
    took = []
    for n in (50_000, 400_000):
        long = piece(n).encode()
        start = time.process_time()
        assert encoder.decode(encoder.encode_piece(long)) == long
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0]  # 8 times the bytes


def test_bpe_of_texts_beyond_four_megabytes(spark, vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    rnd = random.Random(5)
    text = " ".join(f"word{rnd.randrange(3000)}" for _ in range(500_000))
    assert len(text) > 1 << 22
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, "x", "c")], "doc_id long, text string, decoded string")
    ids = want.encode_ordinary(text)
    for r in bpe.encode_texts(df, ranks, pattern).collect():
        assert (r.ids, bytes(r.decoded)) == ((ids, text.encode()) if r.doc_id == 1 else (want.encode_ordinary("x"), b"x"))


# --- 6


def test_quality(docs, empty):
    got = quality.score_quality(docs.withColumn("kept", F.lit(3)), quality.vocabularies()).collect()
    for r in got:
        n, chars, symbols, lines, again, failed = brute.quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, again, failed)
        assert not (r.base_failed and r.kept)
    assert quality.score_quality(empty, quality.vocabularies()).count() == 0


def test_fertility_measures():
    f = quality.Fertility(quality.vocabularies())
    found = f.measure([b"the cat the cat", b"", "日本".encode(), b"!!"])
    ids = [i for w in ("the", "cat") for i in f.model.encode(w)]
    assert found[5][0] == 2 * len(ids) and found[8][0] == pytest.approx(np.log2(len(set(ids)))) and found[5][1] == 0 and found[6][1] == 0
    assert [quality.NAMES[k] for k in found[9]] == ["latin", "other", "han", "other"]


def test_quality_is_that_of_the_plain_way(docs, spark):
    """Encodes every word of every text by both vocabularies, and applies every band one by one."""
    import sentencepiece
    import tiktoken

    v = quality.vocabularies()
    piece = sentencepiece.SentencePieceProcessor(model_proto=v.pieces)
    second = tiktoken.Encoding("x", pat_str=v.pattern, mergeable_ranks=bpe.read_ranks(v.ranks), special_tokens={})
    more = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(1, "ไทย" * 30 + " x" * 3, "", "", 0), (2, " ".join(f"слово{k} дом{k % 7}" for k in range(80)), "", "", 0), (3, " ".join("日本語テキスト" for _ in range(60)), "", "", 0), (4, " ".join("\U0001f9ff" + chr(0x1F600 + k) for k in range(70)), "", "", 0)]
    df = docs.union(more).union(spark.createDataFrame([*odd, *odd], SCHEMA))
    bands = dict(quality.BANDS, latin=(1.8, 2.2, 0.1, 5.0, 2.0, 4.0))
    seen = set()
    for r in quality.score_quality(df, v, bands=bands).collect():
        own = (r.text or "").encode().split()
        ids = [i for w in own for i in piece.encode(w.decode())]
        chars, tokens = sum(len(w.decode()) for w in own), max(1, len(ids))
        other = max(1, sum(len(second.encode_ordinary(" " + w.decode())) for w in own))
        share = sum(piece.is_byte(i) for i in ids) / tokens
        entropy = -sum(n / tokens * np.log2(n / tokens) for n in Counter(ids).values())
        assert (r.n_tokens, r.chars_per_token, r.byte_share, r.chars_per_bpe_token) == (len(ids), chars / tokens, share, chars / other) and r.token_entropy == pytest.approx(entropy)
        low, high, most, bits, low2, high2 = bands[r.script]
        bits -= quality.BITS_A_HALVING * max(0, np.log2(quality.FULL_TOKENS / tokens))
        why = (r.chars_per_token < low, r.chars_per_token > high, share > most, entropy < bits - 1e-9, r.chars_per_bpe_token < low2, r.chars_per_bpe_token > high2)
        seen |= {k for k, bad in enumerate(why) if bad}
        assert r.kept == (not r.base_failed and not any(why))
    assert seen >= {0, 1, 3, 4} and all(b[2] < 1 for b in quality.BANDS.values())


def test_bands_reject_by_script(spark):
    good = "".join(t for t, in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 2000").orderBy("doc_id").select("text").limit(1).collect())
    df = spark.createDataFrame([(1, good), (2, "THE!! " * 25 + " ".join(f"A{k}!!" for k in range(40)))], "doc_id long, text string")
    tight = dict(quality.BANDS, latin=(1.35, 8.0, 0.1, 99.0, 1.1, 9.0))
    assert [r.kept for r in quality.score_quality(df, quality.vocabularies(), bands=tight).collect()] == [False, False]
    assert quality.score_quality(df, quality.vocabularies()).orderBy("doc_id").first().kept


def test_fitted_bands_reject_held_out_junk(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where(~quality.held_out() & (F.col("doc_id") % 2 == 0))
    bands, floors = quality.fit_bands(docs, seen, quality.vocabularies())
    low, high, most, _, low2, high2 = bands["latin"]
    assert 1.35 < low < high < 8 and 1.1 < low2 < high2 < 9 and most <= 0.1 and set(floors) == {"latin"} and bands["han"] == quality.BANDS["han"]
    unseen = docs.join(labels.where(quality.held_out()), "doc_id").select("text", "quality")
    got = quality.score_quality(unseen, quality.vocabularies(), bands=bands, floors=floors).where("NOT base_failed").select("quality", "kept").collect()
    poor, good = [r.kept for r in got if r.quality == 0], [r.kept for r in got if r.quality == 1]
    assert len(poor) > 40 and sum(poor) < 0.1 * len(poor) and sum(good) > 0.99 * len(good)
    # texts of long tokens, and of tokens that fall back to bytes, which no labelled row has
    rows = [(1, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600))), (2, " ".join(f"word{k} \U0001f9ff" for k in range(200)))]
    odd = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), quality.vocabularies(), bands=bands, floors=floors).collect()
    assert not any(r.kept or r.base_failed for r in odd)


def test_few_labels_keep_the_fixed_bands(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.fit_bands(docs, labels, quality.vocabularies()) == (quality.BANDS, {})
    assert quality.fit_bands(docs, labels.limit(0), quality.vocabularies()) == (quality.BANDS, {})


def test_bands_are_of_all_labelled_rows(spark):
    """More labelled rows than any sample that was ever drawn, against numpy over all of them; with poor, unlabelled and failing rows,
    null ids, ids that repeat, and a script with too few."""
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "lor", "mentation", "qx")]
    text = lambda n, of: " ".join(rnd.choice(of) for _ in range(n))
    rows = [(k, text(rnd.choice((55, 60, 90, 300)), rnd.sample(words, rnd.randrange(30, 200))), 1) for k in range(9500)]
    rows += [(20_000 + k, text(60, words[:9]), 0) for k in range(50)] + [(30_000 + k, text(60, words[:9]), None) for k in range(50)] + [(40_000 + k, "a b c", 1) for k in range(50)]
    rows += [(50_000 + k, text(60, [f"слово{i}" for i in range(90)]), 1) for k in range(150)] + [(None, text(60, words), 1)] * 2
    again = [(k, text(70, words), 1) for k in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows + again], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(60, 0), (61, 1), (70_000, 1)], "doc_id long, quality int").repartition(3)
    bands, floors = quality.fit_bands(docs, labels, quality.vocabularies())
    good = [r for r in rows + again if r[0] is not None and r[0] < 20_000 and r[0] != 60]
    found = quality.Fertility(quality.vocabularies()).measure([t.encode() for _, t, _ in good])
    least = {}
    for i, n, repeated, *m in zip([r[0] for r in good], found[0], found[4], found[5], found[6], found[7], found[8], found[10]):
        if not (n < 50 or 100 * repeated > 50 * n):
            least[i] = min(least.get(i, m), m)
    tokens, chars, share, bits, second = np.array(list(least.values()), float).T
    x = np.log2(tokens)
    knots = [k for k in quality.KNOTS if min((x < k).sum(), (x > k).sum()) >= quality.LEAST_BESIDE]
    basis = lambda v: np.column_stack([np.ones(len(v)), v, *[np.maximum(0.0, v - k) for k in knots]])
    line = np.linalg.lstsq(basis(x), bits, rcond=None)[0]
    at = np.array([0.0, *knots, x.max()])
    floor = basis(at) @ line + np.quantile(bits - basis(x) @ line, quality.TAIL)
    around = lambda v: [(1 + quality.CHARS_SLACK) * a - quality.CHARS_SLACK * b for a, b in (np.quantile(v, [quality.TAIL, 1 - quality.TAIL]), np.quantile(v, [1 - quality.TAIL, quality.TAIL]))]
    most = min(quality.BANDS["latin"][2], np.quantile(share, 1 - quality.TAIL) + quality.BYTE_SLACK)
    assert len(least) > 9000 and knots and set(floors) == {"latin"} and bands["cyrillic"] == quality.BANDS["cyrillic"]
    assert floors["latin"][0] == pytest.approx(at.tolist()) and floors["latin"][1] == pytest.approx(floor.tolist(), abs=1e-7)
    assert bands["latin"] == pytest.approx((*around(chars), most, floor[-1], *around(second)), abs=1e-7)
    assert quality.fit_bands(docs.repartition(7), labels.repartition(2), quality.vocabularies()) == (bands, floors)


def test_quantiles_are_exact(spark):
    rnd = np.random.default_rng(4)
    data = {("a", "x"): rnd.normal(size=5000), ("a", "y"): np.round(rnd.normal(size=3001), 1), ("b", "x"): np.array([7.0]), ("b", "y"): np.concatenate([[-1e9, 1e9, 5e-324], np.zeros(400), rnd.random(2000)])}
    shares = {"x": [0.0, 0.001, 0.5, 0.999, 1.0], "y": [0.001, 0.37]}
    df = spark.createDataFrame([(s, n, float(v)) for (s, n), values in data.items() for v in values], "script string, name string, value double")
    got = quality.quantiles(df, shares)
    assert set(got) == set(data) and quality.quantiles(df.limit(0), shares) == {}
    for (s, n), values in data.items():
        assert got[s, n] == pytest.approx(np.quantile(values, shares[n]).tolist(), rel=1e-12)


def test_quality_query_is_that_of_the_operator(spark):
    """What is measured once and written gives the verdicts of texts that are scored."""
    sf = SF.replace("sf0.001", "sf0.1")
    scored = quality.fitted(spark, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), sf).drop("text")
    got = quality.op6_quality(spark, sf)
    assert got.columns == scored.columns and sorted(map(repr, got.collect())) == sorted(map(repr, scored.collect()))


# --- 7


def test_language_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = llm.QUERIES["op7_langid"](spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_edges(spark, docs, empty):
    learned = langid.prototypes(docs)
    assert set(learned) == {"en", "de"}
    out = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("x")), learned).collect()}
    for i, t in PAIRS:
        assert (out[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= out[i].score <= 1
    assert langid.identify(empty, learned).count() == 0 and langid.prototypes(empty) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_blocks_of_languages_give_the_same(docs, spark, monkeypatch):
    rnd = random.Random(12)
    texts = [(k, " ".join("".join(rnd.choice("abcdefgh"[k % 5 : k % 5 + 4]) for _ in range(5)) for _ in range(30)), f"l{k % 7}", "s", 0) for k in range(70)]
    df = spark.createDataFrame([*texts, *[(100, None, None, "", 0), (101, "..", "l1", "", 0)]], SCHEMA).union(docs)
    table = langid.profiles(df)
    digest = lambda d: sorted((r.doc_id, r.text or "", r.lang_pred, round(r.score, 9)) for r in d.collect())
    whole = digest(langid.identify_by(df, table))
    assert whole == digest(langid.identify(df, langid.prototypes(df)))
    for n in (1, 2, 4):
        monkeypatch.setattr(langid, "BLOCK", n)
        assert digest(langid.identify_by(df.withColumn("lang_pred", F.lit(1)), table)) == whole
    assert digest(langid.identify_by(df, table.limit(0))) == digest(langid.identify(df, {}))


def test_language_is_that_of_the_plain_way(spark, docs):
    """Trigram counts, one bound vector a trigram, sums and cosines, one document after the other."""
    import zlib

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + [(10_000 + i, t, None) for i, t in PAIRS if len(t or "") < 3000]
    space = langid.Space()

    def vector(text):
        low = [chr(space.letter[ord(c)]) if space.letter[ord(c)] else " " for c in f" {text or ''} "]
        low = [c for k, c in enumerate(low) if c != " " or not k or low[k - 1] != " "]
        v = lambda c: space.of_letter(ord(c) if c != " " else 0).astype(float)
        grams = Counter(zip(low, low[1:], low[2:]))
        return sum((n * np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for (a, b, c), n in grams.items() if b != " "), np.zeros(langid.DIMENSIONS))

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = {}
    for i, t, y in rows:
        if y is not None and not held(i):
            learned[y] = learned.get(y, 0) + vector(t)
    path = f"{common.shared_dir(spark)}/languages-{random.random()}"
    spark.createDataFrame([(i, t, y, "s", 0) for i, t, y in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    for r in langid.op7_langid(spark, path).collect():
        v = vector(dict((i, t) for i, t, _ in rows)[r.doc_id])
        cosine = {y: float(v @ w / np.linalg.norm(w) / np.linalg.norm(v)) if v.any() else 0.0 for y, w in learned.items()}
        best = max(sorted(cosine), key=cosine.get) if v.any() else "und"
        assert r.held_out == held(r.doc_id) and (r.lang_pred == best or cosine[r.lang_pred] == pytest.approx(cosine[best], abs=1e-9))
        assert r.score == pytest.approx(max(0.0, cosine.get(best, 0.0)), abs=1e-6)


def test_bundles_are_sums_of_bound_letters(monkeypatch):
    s = langid.Space(64, 3)
    v = lambda c: s.of_letter(ord(c)) if c != " " else s.of_letter(0)
    want = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in [" ab", "ab ", " ba", "ba "])
    assert (s.bundles(["Ab, 12 bA"])[0] == want).all()
    texts = ["the quick brown fox", "", "Über"]
    whole = s.bundles(texts)
    monkeypatch.setattr(langid, "KEPT", 4)
    assert (langid.Space(64, 3).bundles(texts) == whole).all()


# --- 8


def test_suffixes(docs, monkeypatch):
    small_packs(monkeypatch)
    monkeypatch.setattr(suffixes, "BATCH", 500)
    got = suffixes.remove_earlier(docs.withColumn("kept", F.lit(1)).withColumn("spans", F.lit(1)))
    rows = got.collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in rows} == brute.suffixes(PAIRS)
    for r in rows:
        assert r.n_removed == sum(s.end - s.first for s in r.spans)


def test_suffixes_edges(docs, empty):
    assert suffixes.remove_earlier(empty).count() == 0
    one = docs.where("doc_id = 0")
    assert [r.n_removed for r in suffixes.remove_earlier(one.union(one)).collect()] == [0, 0]
    two = one.union(one.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in suffixes.remove_earlier(two).collect()) == [(False, False), (True, True)]
    text = suffixes.remove_earlier(docs, as_text=True).collect()
    assert all(isinstance(r.kept, str) for r in text)


def test_batch_after_batch_is_scanned_against_the_levels(spark, monkeypatch):
    small_packs(monkeypatch)
    rows = sorted(p for p in PAIRS if len(p[1] or "") < 5000)
    index, got, kept_levels = suffixes.PassageIndex(spark, ranges=5), {}, []
    for k in range(0, len(rows), 12):
        batch = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows[k : k + 12]], SCHEMA).withColumn("kept", F.lit(1))
        for r in index.add(batch).collect():
            got[r.doc_id] = (r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept)))
        kept_levels.append([id(level) for level, _ in index.levels])
    assert got == brute.suffixes(rows)
    sizes = [n for _, n in index.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < len(kept_levels)
    assert any(a[0] == b[0] for a, b in zip(kept_levels, kept_levels[1:]))  # the largest level was left as it was
    assert index.add(spark.createDataFrame([], SCHEMA)).count() == 0 and [n for _, n in index.levels] == sizes


def test_a_crowd_round_one_phrase_is_split(spark, monkeypatch):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [noise(60) + "the phrase that is in all of them" + noise(60) for _ in range(600)]
    texts += [t[20:130] for t in texts[:50]]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA).repartition(3)
    small_packs(monkeypatch, 8000)
    got = suffixes.remove_earlier(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in got} == brute.suffixes(rows)
    many_texts = [noise(60) + "the phrase that is in all of them" + noise(60) for _ in range(3000)]
    runs = suffixes.Runs([t.encode() for t in many_texts], suffixes.DEPTH, suffixes.GRAM)
    h, many, around = runs.grams()
    reply = {p: suffixes.Grams().write(suffixes.Grams().settle([many[at], around[at]], np.arange(at.stop - at.start))) for p, at, _ in packs.by_part(h, 4)}
    largest = lambda key: int(np.unique(key, return_counts=True)[1].max())
    routed = runs.routed(4, {p: x for p, x in reply.items() if x})
    assert largest(runs.key) > 1200 and largest(routed.key) < suffixes.CROWD * 1.5


def test_cuts_are_at_characters(spark):
    same = "".join(chr(0x430 + k % 31) for k in range(39))
    df = spark.createDataFrame([(0, f"р{same}р", "", "", 0), (1, f"\u0400{same}с", "", "", 0), (2, "x" + same * 3 + "\U0001f600", "", "", 0), (3, same * 3 + "\U0001f601", "", "", 0)], SCHEMA)
    raw = {r.doc_id: bytes(r.kept) for r in suffixes.remove_earlier(df).collect()}
    assert raw[1] == b"\xd0\x81"
    kept = {r.doc_id: r.kept for r in suffixes.remove_earlier(df, as_text=True).collect()}
    assert kept[1] == "" and kept[0] == f"р{same}р" and kept[3] == ""


def test_index_family_halves():
    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 100, 4000).astype(np.uint8)
    family, seen = suffixes.IndexFamily(8), {}
    for k in range(0, 3900, 130):
        starts = np.arange(k, k + 130)
        got = family.add(text[k : k + 140], starts - k, np.full(130, k))
        for s, least in zip(starts.tolist(), got.tolist()):
            key = text[s : s + 8].tobytes()
            assert least == seen.setdefault(key, k)
    sizes = [len(x.starts) for x in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 8


# --- 9


def test_mixing(docs):
    rows = mixing.mix(docs.withColumn("size", F.lit(1)).withColumn("_key", F.lit("x"))).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len((r.text or "").encode().split()) and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    want = brute.targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r["size"] for r in rows if r.source == s) / 2 + 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in rows}


def test_positions(docs):
    rows = mixing.positions(mixing.mix(docs)).collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert Counter(r.doc_id for r in rows) == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})
    # the front-loaded source gives more than half of its words in the first half
    # exact positions: no two of a source's documents with words are due at once
    due = [(r.source, r.position) for r in rows if r["size"]]
    assert len(set(due)) == len(due)
    first = [r for r in rows if r.source == "hot"]
    assert sum(r["size"] for r in first if r.position < 0.5) > 0.5 * sum(r["size"] for r in first)


def test_mixing_edges(empty, docs):
    assert mixing.mix(empty).count() == 0 and mixing.positions(mixing.mix(empty)).count() == 0
    blank = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r.target, r.taken) for r in blank} == {(0.0, 0)}


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    from conftest import rows

    assert rows(llm.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(llm.ORACLES[name]).df())


# --- 10


def test_jaccard(docs, monkeypatch):
    small_packs(monkeypatch)
    got = jaccard.near_duplicates(docs.withColumn("component_id", F.lit("x"))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(brute.jaccard(PAIRS))


def test_jaccard_in_chunks(docs, monkeypatch):
    small_packs(monkeypatch)
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(brute.jaccard(PAIRS))


def test_jaccard_edges(docs, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    one = docs.where("doc_id in (0, 1)")
    rows = jaccard.near_duplicates(one.union(one.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert {r.component_id for r in rows} == {0} and {r.n_links for r in rows} == {3}
    lost = jaccard.near_duplicates(one.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert {r.component_id for r in lost} == {None}


def test_prefixes_of_all_orders_meet():
    rnd = np.random.default_rng(6)
    for _ in range(200):
        n = int(rnd.integers(1, 60))
        a = np.unique(rnd.integers(1, 1 << 40, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) > rnd.choice([0, 0.1, 0.2])], rnd.integers(1 << 41, 1 << 42, int(rnd.integers(0, 8))).astype(np.uint64)]))
        if len(a) and len(b):
            both = len(np.intersect1d(a, b))
            df = lambda x: np.where(np.isin(x, a) & np.isin(x, b), 2, 1).astype(np.uint8)
            link, _ = jaccard.linked([x[jaccard.in_order(x, 0, df(x))] for x in (a, b)])
            assert not link[0, 1] or all(np.bitwise_or.reduce(jaccard.prefix_marks(x, df(x))) == 7 for x in (a, b))
            assert bool(link[0, 1]) == (100 * both >= 75 * (len(a) + len(b) - both))


def test_each_order_leaves_fewer_candidates(spark, monkeypatch):
    """Short windows of few long texts: all their shingles are common, and neighbours overlap by any share."""
    rnd = random.Random(11)
    lines = [[f"w{rnd.randrange(300)}" for _ in range(60)] for _ in range(4)]
    cuts = [(rnd.choice(lines), rnd.randrange(44)) for _ in range(150)]
    rows = [(i, " ".join(x[k : k + 16])) for i, (x, k) in enumerate(cuts)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)
    small_packs(monkeypatch, 4000)
    for chunk in (16, 1000):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        left = []
        got = jaccard.near_duplicates(df, filtered=left).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == sorted(brute.jaccard(rows))
        assert left[0] > left[1] > left[2] > left[3] and left[3] > 20


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- what they share


def test_words_and_windows():
    texts = [b"", b"a bb  ccc", b"\x0bx\x0c", b"y" * 70_000 + b" z", b"a bb ccc"]
    w = tokens.Words(texts)
    assert w.counts.tolist() == [len(t.split()) for t in texts]
    h = w.hashes()
    flat = [x for t in texts for x in t.split()]
    assert len({(x, v) for x, v in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))
    three = tokens.window_hashes(h, 3)
    assert three[0] == three[-1] and tokens.fits(w, 3).tolist() == [True, False, False, False, False, False, True]
    assert w.joined(np.ones(len(w), bool)) == [b" ".join(t.split()) for t in texts]
    assert w.joined(np.zeros(len(w), bool)) == [b""] * 5


def test_messages_grow_with_the_packs(monkeypatch):
    """Packs times the radix a hop, and the radix has a bound: four sizes, the last ones beyond what two hops reach."""

    def shape(count):
        p = object.__new__(packs.Packs)
        p.count = count
        p._tree()
        return p.hops, p.radix, p.hops * p.radix

    found = [shape(n) for n in (85, 422, 25_000, 5_000_000, 50_000_000)]
    assert [h for h, _, _ in found] == [2, 2, 2, 3, 4] and all(r <= packs.FAN for _, r, _ in found) and max(m for _, _, m in found) <= 3 * packs.FAN


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_answers_do_not_depend_on_the_tree(docs, monkeypatch, hops):
    small_packs(monkeypatch, 3000)
    monkeypatch.setattr(packs, "LEAST_HOPS", hops)
    got = substrings.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in got} == brute.substrings(PAIRS)
    cut = suffixes.remove_earlier(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), brute.sha(bytes(r.kept))) for r in cut} == brute.suffixes(PAIRS)


def test_packs_keep_every_row_and_column(spark, docs, monkeypatch):
    small_packs(monkeypatch, 1000)
    p = packs.Packs(docs, "text", "test")
    back = p.finish(lambda batch: iter([batch]), docs.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect())) and p.df.count() > 3


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_sweep_deletes_what_was_written(spark):
    df = common.written(spark.range(3).toDF("x"), "swept")
    assert df.count() == 3 and common.sweep(spark) >= 1
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.count()


# --- the pipeline


def test_pipeline_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, rows, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    ids = {r.doc_id for r in kept.collect()}
    assert all(not brute.quality(r.text)[5] for r in rows.collect() if r.doc_id in ids)
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    alone = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(i for i, _, c, _ in brute.jaccard(pairs) if i == c)
    cut = corpus_pipeline.drop_repeated_passages(spark, alone, SF).collect()
    want = brute.suffixes([(r.doc_id, r.text) for r in alone.collect()])
    for r in cut:
        assert r.n_chars == len(r.text) and (want[r.doc_id][1] > 0 or want[r.doc_id][3] == brute.sha(r.text.encode()))


def test_one_row_of_each_component_stays(spark, monkeypatch):
    small_packs(monkeypatch)
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcd"]
    near = texts[0].replace("a59", "x")
    rows = [(1, texts[0]), (1, texts[0]), (2, near), (None, near), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    left = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert sorted(map(repr, [(r.doc_id, r.text) for r in left])) == sorted(map(repr, [(1, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, None), (None, "")]))


def corpus(spark) -> list[tuple]:
    """Prose with copies, near copies, repeated rows, null ids, passages that several share, Cyrillic text and junk."""
    rnd = random.Random(21)
    prose = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 500 and 3000").orderBy("doc_id").collect()][:60]
    words = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой весь год от так для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место".split()
    russian = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = russian(20)
    out = [(k, t, y, s) for k, (t, y, s) in enumerate(prose)]
    out += [(100 + k, f"{russian(70)} {'рс'[k % 2]}{shared}{'тя'[k % 2]} {russian(60)}", "ru", None) for k in range(12)]
    out += [(200 + k, *prose[k]) for k in range(8)] + [(210 + k, prose[20 + k][0].replace(" ", f" x{k} ", 1), *prose[20 + k][1:]) for k in range(8)]
    out += [(220 + k, f"{prose[30 + k][0]} {prose[40][0][:300]}", "en", "mixed") for k in range(6)]
    out += [out[3]] * 3 + [(None, *prose[50])] * 2 + [(300, None, "en", "s"), (301, "", None, None), (302, "%%% " * 200, "en", "s"), (303, "a b c", "en", "s")]
    rnd.shuffle(out)
    return out


def test_pipeline_is_that_of_the_plain_way(spark, monkeypatch):
    """All five stages of run(), with nothing of this package but the bands and the scripts' names."""
    import public_tokenizers
    import sentencepiece
    import tiktoken

    small_packs(monkeypatch, 8000)
    rows = corpus(spark)
    path = f"{common.shared_dir(spark)}/corpus-{random.random()}"
    spark.createDataFrame([(i, t, y, s, None if t is None else len(t)) for i, t, y, s in rows], SCHEMA).withColumn("extra", F.lit(1)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    v = quality.vocabularies()
    piece = sentencepiece.SentencePieceProcessor(model_proto=v.pieces)
    second = tiktoken.Encoding("x", pat_str=v.pattern, mergeable_ranks=bpe.read_ranks(v.ranks), special_tokens={})
    script = lambda t: "cyrillic" if sum("а" <= c <= "я" for c in t) * 2 > len(t) else "latin"
    kept = [r for r in rows if brute.verdict(r[1], piece, second, quality.BANDS, script(r[1] or ""), quality.FULL_TOKENS, quality.BITS_A_HALVING)]
    found = brute.jaccard([r[:2] for r in kept])
    first, alone = set(), []
    for r, (i, _, c, _) in sorted(zip(kept, found), key=lambda x: brute.order(x[0][0])):
        own = (c, r[1]) if c is None else c
        if own not in first and (i == c):
            first.add(own)
            alone.append(r)
    assert len(rows) > len(kept) > len(alone) > 60 and len({r[0] for r in alone}) == len(alone)
    text = brute.cut_text([r[:2] for r in alone])
    left = [(r[0], text[r[0]], r[3], r[2]) for r in alone if text[r[0]].strip(" \t\n\r\x0b\x0c")]
    assert any(t != dict((r[0], r[1]) for r in alone)[i] for i, t, _, _ in left if i is not None and 100 <= i < 112)
    mixed = brute.mixture([x[:3] for x in left])
    lang = {x[0]: x[3] for x in left}
    last = tiktoken.Encoding("y", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    want = []
    for i, t, s, copies in mixed:
        ids = last.encode_ordinary(t)
        want += [repr((i, lang[i], s, len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(t.encode())))] * copies
    got = [repr((r.doc_id, r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.where("n_tokens < 1").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][-1].startswith("byte-level")


def test_tables_go_when_the_next_stage_has_written(spark):
    corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)  # deletes what is left of other tests
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50
    made = [path for path, _ in common._WRITTEN if "-mixing-sources" in path or "-n-gram" in path or "-suffix" in path or "-quality" in path]
    assert len(made) >= 1 and made[-1] in common._WRITTEN[-1][0] and not [t for _, t in common.written_since(len(common._WRITTEN) - 1) if t]


def test_a_stage_deletes_what_earlier_ones_left(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    own = lambda n: [path.rsplit("vexel-", 1)[1].split("-")[0] for path, _ in common.written_since(n)]
    corpus_pipeline.keep_quality(spark, rows, SF)
    before = common.remembered()
    alone = corpus_pipeline.drop_near_duplicates(spark, rows, SF)
    assert "jaccard" in own(before)
    cut = corpus_pipeline.drop_repeated_passages(spark, alone, SF)  # reads what the stage before wrote: it stays
    assert "jaccard" in own(before) and alone.count() >= cut.count() > 0
    docs = common.written(cut, "kept")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert set(own(before)) == {"kept", "mixed"} and mixed.count() > 0
    corpus_pipeline.mix_sources(spark, spark.createDataFrame(docs.collect(), docs.schema), SF)  # not a table: nothing can be told, so all stays
    assert sorted(own(before)) == ["kept", "mixed", "mixed"] and mixed.count() > 0


def test_stages_on_awkward_and_empty_tables(spark, docs, empty):
    # repeated rows, null ids and a column whose name clashes with what stages add
    more = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    for df in (docs.withColumn("extra", F.lit(1)), more.withColumn("kept", F.lit("x")).withColumn("Representative", F.lit(1)), empty):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df.count()
