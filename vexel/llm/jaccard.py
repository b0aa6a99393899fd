"""Operator 10: near-duplicate documents by an n-gram Jaccard join with filters under several global orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .common import release, remembered, salted_join, sweep, written
from .graph import components
from .packs import Counts, Messages, Packs, Replies, answers_to, arrays, by_part, columns, distinct, expand, keyed, squeeze
from .tokens import Words, fits, mix, window_hashes

#: Words of a shingle, least similarity in per cent, global orders whose prefixes must all meet.
SHINGLE, PERCENT, ORDERS = 5, 75, 3
#: Sets of a candidate component that are compared in one task; larger components are cut into pairs of chunks.
CHUNK = 128
#: Columns of the matrices of shared shingles that are multiplied at a time.
SLAB = 4096


class Sets:
    """The distinct shingles of each text of a pack, sorted, with a 128-bit key for equal sets."""

    def __init__(self, texts: list[bytes], size: int):
        words = Words([t.lower() for t in texts])
        h, known = (words.hashes() if len(words) else np.zeros(0, np.uint64)), {}
        shingles = window_hashes(h, size, known)
        first, counts = words.first, words.counts
        tokens, lengths = [], []
        for i, n in enumerate(counts.tolist()):
            a = int(first[i])
            if n >= size:
                own = np.sort(shingles[a : a + n - size + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif n:  # fewer words: the whole sequence is the one shingle
                own = mix(window_hashes(h, n, known)[a : a + 1], 1000 + n)
            else:
                own = h[:0]
            tokens.append(own)
            lengths.append(len(own))
        self.tokens = np.concatenate(tokens) if tokens else h
        self.lengths = np.array(lengths, np.int64)
        ends = np.cumsum(self.lengths)
        self.begins = ends - self.lengths
        full = self.lengths > 0
        self.keys: list[bytes | None] = [None] * len(texts)
        if full.any():
            two = [np.add.reduceat(mix(self.tokens, s), self.begins[full]) + self.lengths[full].astype(np.uint64) for s in (7, 8)]
            data = np.stack(two, axis=1).astype(">u8").tobytes()
            for k, i in enumerate(np.flatnonzero(full).tolist()):
                self.keys[i] = data[16 * k : 16 * k + 16]
        #: The first text of each class of equal sets.
        self.leaders = [*{k: i for i, k in reversed([*enumerate(self.keys)]) if k is not None}.values()]

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.begins[i] : self.begins[i] + self.lengths[i]]

    def of_leaders(self) -> np.ndarray:
        return np.concatenate([self.of(i) for i in self.leaders]) if self.leaders else self.tokens[:0]


def in_order(tokens: np.ndarray, k: int, df: np.ndarray | None = None) -> np.ndarray:
    """Where the shingles of a set stand in global order k. The first order puts rarer shingles (by df) first, which leaves the
    fewest candidates; the others are shuffles of all shingles by a hash, unlike it and each other, the same for all sets."""
    by = mix(tokens, 20 + k)
    return np.argsort(by) if df is None else np.lexsort((by, df))


def prefix_marks(tokens: np.ndarray, df: np.ndarray, percent: int = PERCENT, orders: int = ORDERS) -> np.ndarray:
    """For each shingle of a set a bit for each order: it is in the prefix, and another set has it.

    A partner shares ceil(t n) of the n shingles at least, so one of the first n - ceil(t n) + 1, whatever the order."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    marks = np.zeros(n, np.uint8)
    for k in range(orders):
        first = in_order(tokens, k, None if k else df)[:size]
        marks[first[df[first] > 1]] |= 1 << k
    return marks


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as products of the matrices of what at least two have."""
    m = len(lists)
    out = np.zeros((m, m), np.float32)
    if not m:
        return out
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(flat) else new
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, SLAB):
        here = (column >= at) & (column < at + SLAB)
        x = np.zeros((m, SLAB), np.float32)
        x[owner[here], column[here] - at] = 1
        out += x @ x.T
    return out


def linked(tokens: list[np.ndarray], percent: int = PERCENT, orders: int = ORDERS, counted: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """Which pairs of sets (shingles in the first order) are similar: those whose prefixes meet under every order are
    candidates, and are verified. Also how many pairs are candidates under the first order, the first two and so on, and
    how many are similar. counted: the pairs to look at, where not all.

    Similar sets of a and b shingles share c = ceil(t (a + b) / (1 + t)) at least, so their first common one is among the first
    a - c + 1 and b - c + 1 under any order. A set's prefix has the length that the partners still left for it ask for."""
    n = np.array([len(t) for t in tokens], np.int64)
    sums = n[:, None] + n[None, :]
    near = np.minimum.outer(n, n) * 100 >= percent * np.maximum.outer(n, n)
    np.fill_diagonal(near, False)
    if counted is not None:
        near &= counted
    share = -(-percent * sums // (100 + percent))
    left = [0] * (orders + 1)
    for k in range(orders):
        if not near.any():
            return near, left
        least = np.where(near, share, np.iinfo(np.int64).max).min(axis=1)
        size = np.maximum(0, n - least + 1).tolist()
        near &= overlaps([(t if k == 0 else t[in_order(t, k)])[:m] if m else t[:0] for t, m in zip(tokens, size)]) > 0
        left[k] = int(near.sum()) // 2
    if near.any():
        common = overlaps(tokens).astype(np.int64)
        near &= 100 * common >= percent * (sums - common)
    left[orders] = int(near.sum()) // 2
    return near, left


def local_roots(link: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    root = np.arange(len(link))
    while True:
        least = np.minimum(root, np.where(link, root[None, :], len(link)).min(axis=1, initial=len(link)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, orders: int = ORDERS, text: str = "text", id_col: str = "doc_id", filtered: list[int] | None = None) -> DataFrame:
    """Adds n_shingles, component_id (the smallest id reachable by links, the row's own included) and n_links to every row.

    A row's set are the distinct shingles of its words, A to Z lower-cased; with fewer words than a shingle has, all
    its words as one. Rows link when their sets' Jaccard similarity is percent / 100 or more; n_links counts the rows
    that a row is linked with. Sets are compared by 64-bit hashes of shingles, equal sets found by 128-bit keys.

    1. Rows with equal sets become a class. Packs ask in how many packs' classes each shingle is.
    2. A class takes the prefix of its set under each of several global orders. One that has no prefix shingle in common
       with others under any one order has no link at all. The others' prefixes under the first order are joined to
       stars, each shingle's classes at the least of them; components of the stars hold every link.
    3. A component's sets meet in one task, or, if it is large, by chunks: a task for each pair of chunks of which some sets
       share a prefix shingle, and none for other pairs. There, pairs of sets that share prefix shingles under all orders are
       verified. What goes on are the roots of the tasks' components, so a group of near copies sends a row a class, not
       its pairs. Their components are the result.

    Null texts and texts without words have no set, no link and component_id their own id. Null ids take part, but are
    no component_id (null if all are). Repeated rows link with each other. representative marks one row of each component, with
    the smallest id (null after all others), then pack and row; rows without a set are alone in theirs. An empty table gives an empty result. Other
    columns stay; those named like the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_shingles", "component_id", "n_links", "representative")
    packs = Packs(docs, text, "jaccard")
    radix, before = packs.radix, remembered()

    def sets_of(batch: pa.RecordBatch) -> Sets:
        return Sets([x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()], size)

    def ask_counts(batch: pa.RecordBatch) -> Messages:
        h, n = distinct(sets_of(batch).of_leaders())
        for p, at, keys in by_part(h, radix):
            yield p, keyed(keys, np.minimum(n[at], 255).astype(np.uint8))

    def describe(batch: pa.RecordBatch, pack: int, counts: Replies) -> Iterator[pa.RecordBatch]:
        sets = sets_of(batch)
        keys, _ = distinct(sets.of_leaders())
        df = answers_to(Counts(), keys, radix, counts)
        rows = [(i, x, k, int(sets.lengths[i]), None, None) for i, (x, k) in enumerate(zip(batch.column(id_col).to_pylist(), sets.keys)) if k is not None]
        every = (1 << orders) - 1
        for i in sets.leaders:
            tokens = sets.of(i)
            own = df[np.searchsorted(keys, tokens)]
            order = in_order(tokens, 0, own)
            tokens = tokens[order]
            marks = prefix_marks(tokens, own[order], percent, orders)
            if np.bitwise_or.reduce(marks) == every:
                rows.append((None, None, sets.keys[i], len(tokens), tokens.tobytes(), squeeze(marks.tobytes())))
        cols = [list(x) for x in zip(*rows)] or [[]] * 6
        types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([pack] * len(rows), pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types)]], names=["pack", "row", "id", "key", "n", "tokens", "marks"])

    counts = packs.ask(ask_counts, Counts(), "counts")
    df, names = packs._with(counts)
    found = written(packs._over(df, names, describe, "pack long, row int, id long, key binary, n long, tokens binary, marks binary"), "jaccard-sets")
    rows = found.where("tokens IS NULL").select("pack", "row", "id", "key", "n")
    sets = found.where("tokens IS NOT NULL").select("pack", "key", "tokens", "marks")

    def node(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join([k[:8] for k in keys]), ">i8").astype(np.int64)

    def send_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each prefix shingle (first order) of a slice of sets one of its sets, and edges from the others to that one."""
        for batch in slices(batches, "tokens"):
            own = prefixes(batch)
            who = np.repeat(node(batch.column("key").to_pylist()), [len(x) for x in own])
            h = np.concatenate(own).astype(np.int64)
            order = np.lexsort((who, h))
            h, who = h[order], who[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            least = np.repeat(who[first], np.diff(np.append(first, len(h))))
            edges = np.unique(np.stack([who, least], axis=1)[who != least], axis=0)
            shingle = pa.concat_arrays([pa.array(h[first]), pa.nulls(len(edges), pa.int64())])
            yield pa.RecordBatch.from_arrays([shingle, pa.array(np.concatenate([who[first], edges[:, 0]])), pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(edges[:, 1])])], names=["h", "a", "b"])

    def prefixes(batch: pa.RecordBatch) -> list[np.ndarray]:
        tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
        marks = [np.frombuffer(expand(m), np.uint8) for m in batch.column("marks").to_pylist()]
        return [t[m & 1 == 1] for t, m in zip(tokens, marks)]

    sent = written(sets.mapInArrow(send_prefixes, "h long, a long, b long"), "jaccard-prefixes")
    heads = sent.where("h IS NOT NULL").select("h", "a")
    centers = heads.groupBy("h").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b <> last").select("h", "b")
    edges = salted_join(heads, centers, "h", "a").select("a", "b").union(sent.where("h IS NULL").select("a", "b"))
    coarse = components(edges).select("node", F.col("root").alias("coarse"))

    # one row of each class speaks for it
    classes = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "pack", "row")).alias("least"), F.count("*").alias("copies"))
    speakers = sets.groupBy("key").agg(F.min("pack").alias("pack")).withColumn("node", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long"))
    placed = speakers.join(coarse, "node").join(classes.select("key", "copies"), "key")
    sizes = placed.groupBy("coarse").agg(F.count("*").alias("members"))
    placed = salted_join(placed, sizes, "coarse", "key").select("key", "pack", "copies", "coarse", "members")
    shared = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), packs.count)
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    placed = written(placed.withColumn("own", F.when(F.col("members") > CHUNK, F.pmod(F.xxhash64("key"), chunks)).cast("int")), "jaccard-places")
    # whole components share tasks
    whole = placed.where("own IS NULL").select("key", "pack", "copies", "coarse", F.lit(-1).alias("own"), F.pmod(F.xxhash64("coarse"), F.lit(shared)).alias("block"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))

    def send_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            own = prefixes(batch)
            n = [len(x) for x in own]
            all_ = np.stack([np.concatenate(own).astype(np.int64), *[np.repeat(batch.column(c).to_numpy(), n) for c in ("coarse", "own")]], axis=1)
            found = np.unique(all_, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(3)], names=["h", "coarse", "own"])

    # chunks of large ones meet where some of their sets share a prefix shingle: each has a task with itself and with each such other
    large = placed.where("own IS NOT NULL")
    has = written(sets.join(large, ["key", "pack"]).select("tokens", "marks", "coarse", "own").mapInArrow(send_chunks, "h long, coarse long, own long").distinct(), "jaccard-chunks")
    meet = has.select("h", "coarse", F.col("own").alias("i")).join(has.select("h", "coarse", F.col("own").alias("j")), ["h", "coarse"]).where("i <= j").select("coarse", "i", "j").distinct()
    sides = meet.select("coarse", "i", "j", F.col("i").alias("own")).union(meet.where("i <> j").select("coarse", "i", "j", F.col("j").alias("own")))
    apart = large.select("key", "pack", "copies", "coarse", "own").join(sides.withColumn("own", F.col("own").cast("int")), ["coarse", "own"])
    placed = whole.union(apart.select("key", "pack", "copies", "coarse", "own", F.col("coarse").alias("block"), F.col("i").cast("int"), F.col("j").cast("int")))

    def verify(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        groups: dict[int, list[int]] = {}
        for k, c in enumerate(t["coarse"]):
            groups.setdefault(c, []).append(k)
        key, root, links, left = [], [], [], np.zeros(orders + 1, np.int64)
        for members in groups.values():
            members.sort(key=lambda k: t["key"][k])
            tokens = [np.frombuffer(t["tokens"][k], np.uint64) for k in members]
            across = None
            if t["i"][members[0]] != t["j"][members[0]]:  # pairs within a chunk are another task's
                side = np.array([t["own"][k] for k in members])
                across = side[:, None] != side[None, :]
            link, pairs = linked(tokens, percent, orders, across)
            left += pairs
            some = link.any(axis=1)
            copies = np.array([t["copies"][k] for k in members], np.int64)
            roots, n = local_roots(link), link @ copies
            for x in np.flatnonzero(some).tolist():
                key.append(t["key"][members[x]])
                root.append(t["key"][members[int(roots[x])]])
                links.append(int(n[x]))
        none = [None] * len(key)
        return pa.table({"a": pa.array([*key, None], pa.binary()), "b": pa.array([*root, None], pa.binary()), "links": pa.array([*links, None], pa.int64()), "left": pa.array([*none, left.tolist()], pa.list_(pa.int64()))})

    joined = sets.drop("marks").join(placed, ["key", "pack"])
    found_ = written(joined.groupBy("block", "i", "j").applyInArrow(verify, "a binary, b binary, links long, left array<long>"), "jaccard-links")
    if filtered is not None:
        filtered += [x or 0 for x in found_.agg(*[F.sum(F.element_at("left", k + 1)) for k in range(orders + 1)]).first()]
    links = found_.where("a IS NOT NULL").select("a", "b", "links")
    roots = components(links.select("a", "b")).select(F.col("node").alias("key"), "root")
    counts_ = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    classes = classes.join(roots, "key", "left").join(counts_, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    least = classes.groupBy("root").agg(F.min("least").alias("first"))
    classes = salted_join(classes, least, "root", "key").select("key", F.col("first.id").alias("component"), F.col("first.pack").alias("first_pack"), F.col("first.row").alias("first_row"), "links")

    def answer(table: pa.Table) -> pa.Table:
        none = table.column("component").is_null().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        cols = [table.column(c).fill_null(0).to_numpy() for c in ("row", "n", "component", "links")]
        chosen = np.asarray(table.column("chosen").to_numpy(), bool)
        return pa.table({"pack": table.column("pack").slice(0, 1), "part": pa.array([0], pa.int32()), "answer": pa.array([arrays(*[c.astype("<i8") for c in cols], none, chosen)], pa.binary())})

    chosen = ((F.col("pack") == F.col("first_pack")) & (F.col("row") == F.col("first_row"))).alias("chosen")
    answers = written(salted_join(rows, classes, "key", "pack").select("pack", "row", "n", "component", "links", chosen).groupBy("pack").applyInArrow(answer, "pack long, part int, answer binary"), "jaccard-answers")
    release(spark)
    sweep(spark, before, keep=1)  # what led to the answers

    def finish(batch: pa.RecordBatch, reply: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids = batch.column(id_col).to_pylist()
        n, links, alone = [0] * len(ids), [0] * len(ids), [True] * len(ids)
        if 0 in reply:
            for r, a, c, k, none, first in zip(*[x.tolist() for x in columns(reply[0], "<i8", "<i8", "<i8", "<i8", "?", "?")]):
                n[r], ids[r], links[r], alone[r] = a, None if none else c, k, first
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(alone)], names=[*batch.schema.names, "n_shingles", "component_id", "n_links", "representative"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_shingles", T.LongType()), T.StructField("component_id", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("representative", T.BooleanType())])
    return packs.finish(finish, schema, answers)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c.b) FROM c WHERE c.a = d.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM d LEFT JOIN n USING (doc_id)
"""
