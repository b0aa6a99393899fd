"""Operator 1: exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered

#: Rows of a block of queries, and of a block of candidates, at most on average.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 16_384


def rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each weight that isn't 0, of the last column."""
    lists = table.column("weights").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(lists):
        return (np.zeros(0, np.int64),) * 3
    lengths = np.diff(lists.offsets.to_numpy())
    weights = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = weights != 0
    return row[there], term[there], weights[there]


def search(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of each query of one pair of blocks.

    The candidates become posting lists, a list a term. A query adds each of its terms' weighted list to an array with a
    score for each candidate; where a list has every candidate, it is added as it stands. Then the k-th best score is
    found by partition, and what lies above it, with as many at it as are left to take, by the smaller ids.
    """
    if "id" not in queries.column_names or "id" not in candidates.column_names or not queries.num_rows or not candidates.num_rows:  # a side without rows comes without columns
        none = pa.array([], pa.int64())
        return pa.table({c: none for c in ("query_row", "query_id", "vec_id", "row", "score")})
    candidates = candidates.sort_by([("id", "ascending"), ("row", "ascending")])
    n = candidates.num_rows
    row, term, weight = rows_of(candidates)
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    terms, first = np.unique(term, return_index=True)
    lists = {int(t): (None if b - a == n else row[a:b], weight[a:b]) for t, a, b in zip(terms, first, np.append(first[1:], len(term)))}
    q_row, q_term, q_weight = rows_of(queries)
    ends = np.searchsorted(q_row, np.arange(queries.num_rows + 1))
    own, theirs = queries.column("row").to_numpy(), candidates.column("row").to_numpy()
    at = {int(x): i for i, x in enumerate(theirs.tolist())}
    scores, least = np.zeros(n, np.int64), np.iinfo(np.int64).min
    q_out, c_out, s_out = [], [], []
    for q in range(queries.num_rows):
        scores[:] = 0
        for t, w in zip(q_term[ends[q] : ends[q + 1]].tolist(), q_weight[ends[q] : ends[q + 1]]):
            rows, weights = lists.get(t, (None, None))
            if weights is None:
                continue
            if rows is None:
                scores += weights * w
            else:
                scores[rows] += weights * w
        mine = at.get(int(own[q]))
        many = n - (mine is not None)
        take = min(k, many)
        if take <= 0:
            continue
        kept = scores if mine is None else np.delete(scores, mine)
        bound = np.partition(kept, many - take)[many - take]
        above = np.flatnonzero(scores > bound)
        level = np.flatnonzero(scores == bound)
        if mine is not None:
            above, level = above[above != mine], level[level != mine]
        best = np.concatenate([above, level[: take - len(above)]])
        q_out += [q] * len(best)
        c_out.append(best)
        s_out.append(scores[best])
    q_at = np.array(q_out, np.int64)
    c_at = np.concatenate(c_out) if c_out else np.zeros(0, np.int64)
    return pa.table({"query_row": own[q_at], "query_id": queries.column("id").take(q_at), "vec_id": candidates.column("id").take(c_at), "row": theirs[c_at], "score": np.concatenate(s_out) if s_out else np.zeros(0, np.int64)})


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors: id (long), weights (array of long, without nulls). For every row that is_query holds for, the k other rows
    with the largest inner products: query_id, rank (from 1), vec_id, score. Ties go to the smaller id.

    Every query meets every candidate, in blocks of bounded size: candidates are dealt into buckets by row number, so
    evenly, and queries into blocks, and each pair is one group of a co-grouped map. Each side is copied once for
    each block of the other. What a group returns is k rows a query, merged by a window over each query.

    Rows get a number once, in a written table, so that a query knows its own row whatever is computed again.

    Vectors of unlike length are compared as if padded with 0, empty ones score 0 with all. Rows with the same id are
    rows of their own: a query skips its own row only, and a repeated query row gets a ranking of its own. Null ids
    match no other id. Fewer than k other rows: all of them; an empty table or no queries: an empty result. Scores are
    64-bit and wrap.
    """
    spark = vectors.sparkSession
    vectors = numbered(vectors.select("id", "weights").withColumn("q", F.coalesce(is_query, F.lit(False))), "top-k", "row")
    total, asked = vectors.agg(F.count("*"), F.count_if("q")).first()
    blocks = max(1, -(-asked // QUERY_ROWS))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CANDIDATE_ROWS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    bucket = F.pmod(F.col("row"), F.lit(buckets)).cast("int")
    queries = vectors.where("q").select("id", "row", "weights", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    candidates = vectors.select("id", "row", "weights", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), bucket.alias("bucket"))
    keys = ["block", "bucket"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda a, b: search(a, b, k), "query_row long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return exact_top_k(e.where(fine).select(F.col("vec_id").alias("id"), scaled.alias("weights")), F.col("id") % 50 == 0, k=5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
