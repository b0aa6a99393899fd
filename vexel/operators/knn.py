"""Exact k-nearest-neighbour search. Ties go to the smaller id everywhere; k of 0 gives nothing, k over n gives all."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels, vectors

#: Queries that are sent to all tasks at once, and bytes of them at most. Beyond, both sides are dealt into blocks.
BATCH_QUERIES, BATCH_BYTES = 4096, 32 << 20
BLOCK_ROWS = 16_384
#: Rows of a block that is multiplied (of queries half as many) and bytes of them, and rows that are worth a block of their own.
PRODUCT_ROWS, PRODUCT_BYTES, LEAST_ROWS = 65_536, 32 << 20, 1024


def found_schema(corpus: DataFrame, queries: DataFrame) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, id {kind(corpus, 'id')}, distance double"


def literal(q: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def ranked(df: DataFrame, q: list[float], metric: str = "l2", embedding: str = "embedding") -> DataFrame:
    """Adds distance to q, and score."""
    if metric not in vectors.METRICS:
        raise ValueError(f"unknown metric {metric}")
    return df.withColumn("distance", vectors.METRICS[metric](F.col(embedding), literal(q))).withColumn("score", vectors.score("distance"))


def nearest(corpus: DataFrame, q: list[float], k: int, metric: str = "l2", where: Column | None = None, min_score: float = 0.0) -> DataFrame:
    """The k rows (id, embedding, ...) nearest to q. where is applied before the ranking, so it reaches the scan; min_score
    after it. One pass: a kernel keeps the k best rows of a batch, which a bounded heap in each task and their merge cut to k.
    Rows without a vector are never near."""
    if metric not in vectors.METRICS:
        raise ValueError(f"unknown metric {metric}")
    rows = corpus if where is None else corpus.where(where)
    if k <= 0:
        return ranked(rows, q, metric).limit(0)
    if "score" in rows.columns:
        rows = rows.drop("score")
    near = kernels.nearest_rows(rows, q, k, metric).withColumn("score", vectors.score("distance"))
    out = near.orderBy("distance", "id").limit(k)
    return out.where(F.col("score") >= min_score) if min_score > 0 else out


def top_k(df: DataFrame, by: Column, k: int, tie: str = "id") -> DataFrame:
    """The k rows with the largest value, ties by id."""
    return df.orderBy(by.desc(), F.col(tie)).limit(k)


def top_k_each(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank from 1. Tasks cut their own rows to k a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collect_queries(queries: DataFrame, limit: int = BATCH_QUERIES) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of (query_id, q), or None if they are more than may be sent to every task."""
    rows = queries.select("query_id", "q").limit(limit + 1).collect()
    if len(rows) > limit or sum(len(r.q) for r in rows) * 8 > BATCH_BYTES:
        return None
    return np.array([r.query_id for r in rows]), np.array([r.q for r in rows], np.float64).reshape(len(rows), -1)


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance, score) for every query (query_id, q), over corpus (id, embedding).

    Few queries go to all tasks, which scan their rows once and return k rows a query and batch. Many queries meet the
    corpus in pairs of blocks of bounded size. Either way what is shuffled to be ranked is k rows a query and batch."""
    if metric not in vectors.METRICS:
        raise ValueError(f"unknown metric {metric}")
    few, schema = collect_queries(queries), found_schema(corpus, queries)
    if few is not None:
        ids, qs = few
        if not len(ids) or k <= 0:
            found = corpus.sparkSession.createDataFrame([], schema)
        else:
            found = kernels.over_batches(corpus.select("id", "embedding"), lambda b: kernels.one_batch(kernels.rank_batch(kernels.ids_of(b.column(0)), kernels.matrix(b.column(1)), ids, qs, k, metric)), schema)
    else:
        found = pairs_of_blocks(corpus.select("id", "embedding"), queries, k, metric, schema)
    out = top_k_each(found, "query_id", [F.col("distance"), F.col("id")], k)
    return out.select("query_id", "rank", "id", "distance", vectors.score("distance").alias("score"))


def as_floats(df: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """The table, with vectors of 32 bits if all numbers are such, its rows, and its longest vector. One scan."""
    same = F.forall(vector, lambda x: x.cast("float").cast("double") == x)
    n, floats, most = df.agg(F.count("*"), F.min(F.coalesce(same, F.lit(False))), F.max(F.size(vector))).first()
    return (df.withColumn(vector, F.transform(vector, lambda x: x.cast("float"))) if floats else df), n, most or 0


def pairs_of_blocks(corpus: DataFrame, queries: DataFrame, k: int, metric: str, schema: str, allowed=None) -> DataFrame:
    """Many queries against a corpus in pairs of blocks of bounded size, and enough of them for all cores. allowed(queries, rows of a
    pair): which rows each may have."""
    if allowed is None:
        queries, n_queries, wide = as_floats(queries, "q")
        corpus, n, width = as_floats(corpus, "embedding")
        most = max(2, min(PRODUCT_ROWS, PRODUCT_BYTES // (8 * max(1, wide, width))))
        tasks = math.ceil(math.sqrt(4 * queries.sparkSession.sparkContext.defaultParallelism))
        blocks, buckets = (max(1, -(-rows // size), min(tasks, rows // LEAST_ROWS)) for rows, size in ((n_queries, most // 2), (n, most)))
        # few files are few tasks, and what they hand on is a multiple of what they read
        queries, corpus = queries.repartition(buckets + tasks, "query_id"), corpus.repartition(blocks + tasks, "id")
    else:
        blocks, buckets = -(-queries.count() // BATCH_QUERIES), max(1, -(-corpus.count() // BLOCK_ROWS))
    left = queries.withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)), "bucket": F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))})
    right = corpus.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "bucket": F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")})

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:  # a side without rows comes without columns
            return EMPTY
        own = None if allowed is None else allowed(a, b)
        return kernels.rank_batch(kernels.ids_of(b.column("id")), kernels.matrix(b.column("embedding")), kernels.ids_of(a.column("query_id")), kernels.matrix(a.column("q")), k, metric, own)

    kind = lambda t: pa.string() if t == "string" else pa.int64()
    EMPTY = pa.table({"query_id": pa.array([], kind(queries.schema["query_id"].dataType.simpleString())), "id": pa.array([], kind(corpus.schema["id"].dataType.simpleString())), "distance": pa.array([], pa.float64())})
    return left.groupBy("block", "bucket").cogroup(right.groupBy("block", "bucket")).applyInArrow(pair, schema)


def vector_of(corpus: DataFrame, id_: int) -> list[float]:
    row = corpus.where(F.col("id") == id_).select("embedding").first()
    if row is None:
        raise KeyError(f"no vector {id_}")
    return list(row.embedding)


def find_similar(corpus: DataFrame, id_: int, k: int, metric: str = "cosine") -> DataFrame:
    """The k rows nearest to a stored one, itself included."""
    return nearest(corpus, vector_of(corpus, id_), k, metric)


def mean_vector(corpus: DataFrame, ids: list[int]) -> list[float] | None:
    """Mean of the vectors with these ids; an id given twice counts twice, unknown ones don't count."""
    times: dict[int, int] = {}
    for i in ids:
        times[i] = times.get(i, 0) + 1
    rows = corpus.where(F.col("id").isin([*times])).select("id", "embedding").collect() if times else []
    if not rows:
        return None
    x, w = np.array([r.embedding for r in rows], float), np.array([times[r.id] for r in rows], float)
    return (w @ x / w.sum()).tolist()


def recommend(corpus: DataFrame, history: list[int], k: int) -> DataFrame:
    """The k rows that aren't in the history, nearest by cosine to its mean; none for a history without known ids."""
    q = mean_vector(corpus, history)
    if q is None:
        return ranked(corpus, [], "l2").limit(0)
    return nearest(corpus, q, k, "cosine", where=~F.col("id").isin(history))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Both (query_id, id). One row: mean recall (hits over the smaller of k and the truth's size; 1 for no truth) and mean
    precision (hits over results; 0 for none)."""
    f = found.select("query_id", "id").withColumn("f", F.lit(1))
    t = truth.select("query_id", "id").withColumn("t", F.lit(1))
    by = f.join(t, ["query_id", "id"], "full").groupBy("query_id").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hits"), F.count("f").alias("n_found"), F.count("t").alias("n_true"))
    return by.agg(
        F.avg(F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("hits") / F.least(F.col("n_true"), F.lit(k)))).alias("recall"),
        F.avg(F.when(F.col("n_found") == 0, 0.0).otherwise(F.col("hits") / F.col("n_found"))).alias("precision"),
    )


def expand_query(q: list[float], n: int, noise: float = 0.05, seed: int = 0) -> list[list[float]]:
    """q and n - 1 noisy copies of its length."""
    rng, q0 = np.random.default_rng(seed), np.array(q, float)
    out, length = [q0], float(np.linalg.norm(q0))
    for _ in range(n - 1):
        x = q0 + rng.uniform(-noise, noise, len(q0))
        size = float(np.linalg.norm(x))
        out.append(x * (length / size) if size else x)
    return [x.tolist() for x in out[:n]]
