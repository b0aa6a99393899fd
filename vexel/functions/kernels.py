"""NumPy kernels over Arrow batches, for what expressions would compute row by row: many distances a row.

A kernel keeps what it returns small before anything is shuffled: the k best of a batch of rows, or sums by cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Queries from which rank_batch() multiplies matrices; queries and rows of a tile of products, and rows of which the least product
#: is looked at first; pairs that are kept before they are measured, and pairs that are measured at a time.
FEW, TILE_QUERIES, TILE_ROWS, GROUP, MOST_PAIRS, SLICE = 8, 256, 8192, 32, 1 << 20, 1 << 15
#: The product of a row that isn't one; those of rows are at most 1.5.
BEYOND = 1e30


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix of DOUBLE."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError(f"vectors of dimensions {int(lengths.min())} and {int(lengths.max())}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, int(lengths[0]))


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """From each row of x to the vector q."""
    if x.shape[1] != len(q):
        raise ValueError(f"vectors of dimensions {x.shape[1]} and {len(q)}")
    if metric == "l2":
        d = x - q
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    if metric == "cosine":
        n = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(q @ q)
        return 1 - np.where(n == 0, 0.0, x @ q / np.where(n == 0, 1.0, n))
    raise ValueError(f"unknown metric {metric}")


def best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest, ties by id, in order."""
    if k <= 0 or not len(d):
        return np.zeros(0, np.int64)
    if k < len(d):
        bound = np.partition(d, k - 1)[k - 1]
        at = np.flatnonzero(d <= bound)
    else:
        at = np.arange(len(d))
    return at[np.lexsort((ids[at], d[at]))][:k]


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids, numbers or strings, as an array that sorts as Spark sorts them."""
    out = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def nearest_rows(df: DataFrame, q: list[float], k: int, metric: str, embedding: str = "embedding", id_col: str = "id") -> DataFrame:
    """The k rows of every batch nearest to q, with distance: what may be among the k nearest of all."""
    df = df.drop("distance")
    names, query = df.columns, np.array(q, float)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        d = distances(matrix(b.column(names.index(embedding))), query, metric)
        top = pa.array(best(d, ids_of(b.column(names.index(id_col))), k))
        return pa.RecordBatch.from_arrays([*b.take(top).columns, pa.array(d).take(top)], names=[*names, "distance"])

    return over_batches(df.where(df[embedding].isNotNull()), run, T.StructType([*df.schema.fields, T.StructField("distance", T.DoubleType())]))


def rank_batch(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str, allowed: np.ndarray | None = None) -> pa.Table:
    """The k nearest rows of x to each query; allowed: which rows (second axis) each query may have."""
    if allowed is None and k > 0 and len(ids) and len(queries) >= FEW:
        if x.shape[1] != queries.shape[1]:
            raise ValueError(f"vectors of dimensions {x.shape[1]} and {queries.shape[1]}")
        some = least_copies(ids, x, k)
        scaled = products_of(x if some is None else x[some], queries, metric)
        if scaled is not None:
            ids, x = (ids, x) if some is None else (ids[some], x[some])
            q, at, d = nearest_pairs(ids, x, queries, k, metric, *scaled)
            return pa.table({"query_id": pa.array(query_ids[q]), "id": pa.array(ids[at]), "distance": pa.array(d)})
    q_out, c_out, d_out = [], [], []
    for i, q in enumerate(queries):
        at = np.arange(len(ids)) if allowed is None else np.flatnonzero(allowed[i])
        if not len(at):
            continue
        d = distances(x[at], q, metric)
        top = best(d, ids[at], k)
        q_out.append(np.full(len(top), query_ids[i]))
        c_out.append(ids[at][top])
        d_out.append(d[top])
    cat = lambda xs, like: np.concatenate(xs) if xs else like[:0]
    return pa.table({"query_id": pa.array(cat(q_out, query_ids)), "id": pa.array(cat(c_out, ids)), "distance": pa.array(cat(d_out, np.zeros(0)))})


def least_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray | None:
    """Places of the rows but for those of which k equal ones with smaller ids are there, and which so are never among the k nearest;
    None if that is all of them."""
    bits = np.ascontiguousarray(x).view(np.int64)
    sums = bits @ np.random.default_rng(0).integers(1, 1 << 62, x.shape[1])
    order = np.lexsort((ids, sums))
    first = np.searchsorted(sums[order], sums[order])
    late = np.arange(len(order)) - first >= k
    if not late.any():
        return None
    mixed = np.zeros(len(order), bool)  # rows of one sum that aren't equal: all of them stay
    for i in range(0, len(order), SLICE):
        unlike = (bits[order[i : i + SLICE]] != bits[order[first[i : i + SLICE]]]).any(axis=1)
        mixed[first[i : i + SLICE][unlike]] = True
    return np.sort(order[~late | mixed[first]])


def products_of(x: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Queries and rows in 32 bits, whose product puts the rows of a query in the order of their distance, and by how much two
    products of a query may be out of it. None if numbers aren't finite."""
    with np.errstate(all="ignore"):
        if metric == "cosine":
            unit = lambda v: v / np.where((n := np.sqrt(np.einsum("ij,ij->i", v, v))) == 0, 1.0, n)[:, None]
            a, b = unit(queries), unit(x)
        else:
            middle = x.mean(0)
            a, b = queries - middle, x - middle
        sizes = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (a, b)]
        most = np.concatenate(sizes).max()  # NaN if there is one
        if not np.isfinite(most):
            return None
        scale = 1 / most if most > 0 and np.isfinite(1 / most) else 1.0
        d = x.shape[1]
        left, right = np.ones((len(a), d + 1), np.float32), np.zeros((-(-len(b) // GROUP) * GROUP, d + 1), np.float32)
        left[:, :d], right[: len(b), :d] = a * -scale, b * scale
        right[: len(b), d] = 0 if metric == "cosine" else (sizes[1] * scale) ** 2 / 2
        right[len(b) :, d] = BEYOND
        top = sizes[1].max() * scale
        # twice what the rounding of a product of d + 1 terms, of both factors, and of the bound itself may come to
        slack = 4 * (d + 8) * float(np.finfo(np.float32).eps) * (sizes[0] * scale * top + top * top / 2) + 1e-30
    return left, right, slack.astype(np.float32)


def nearest_pairs(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int, metric: str, left: np.ndarray, right: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k nearest rows, with distances. Products of 32 bits, tile by tile, leave the rows that may be
    among the k nearest; those are measured in 64 bits as everywhere else, so the result is that of measuring all."""
    out = []
    for lo in range(0, len(queries), TILE_QUERIES):
        part, own, room = left[lo : lo + TILE_QUERIES], queries[lo : lo + TILE_QUERIES], slack[lo : lo + TILE_QUERIES, None]
        least = np.full((len(part), k), np.inf, np.float32)  # products of k unlike rows: the last of them is a bound
        kept: list[tuple] = []

        def settled() -> tuple:
            q, at, s = (np.concatenate(c) for c in zip(*kept))
            near = s <= (least[:, k - 1 :] + room)[q, 0]
            q, at, s = q[near], at[near], s[near]
            d = np.concatenate([np.zeros(0), *(measured(x[at[i : i + SLICE]], own[q[i : i + SLICE]], metric) for i in range(0, len(q), SLICE))])
            order = np.lexsort((ids[at], d, q))
            q = q[order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            return np.sort(q, kind="stable")[np.arange(len(q)) - np.searchsorted(q, q) < k], at[order], s[order], d[order]

        for start in range(0, len(right), TILE_ROWS):
            s = part @ right[start : start + TILE_ROWS].T
            width = GROUP
            while width > 1 and s.shape[1] // width < 4 * k:
                width //= 2
            groups = s.reshape(len(part), width, -1)
            lows = groups.min(axis=1)
            least = np.partition(np.concatenate([least, lows], axis=1), k - 1, axis=1)[:, :k]
            bound = least[:, k - 1 :] + room
            q, g = np.nonzero(lows <= bound)
            some = groups[q, :, g]
            i, j = np.nonzero(some <= bound[q])
            at = start + j * groups.shape[2] + g[i]
            real = at < len(x)
            kept.append((q[i][real], at[real], some[i, j][real]))
            if sum(len(c[0]) for c in kept) > MOST_PAIRS:
                kept = [settled()[:3]]
        q, at, _, d = settled()
        out.append((q + lo, at, d))
    return tuple(np.concatenate(c) for c in zip(*out))


def measured(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows in pairs, by the formulas of distances()."""
    if metric == "l2":
        d = x - q
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    n = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q))
    return 1 - np.where(n == 0, 0.0, np.einsum("ij,ij->i", x, q) / np.where(n == 0, 1.0, n))


def one_batch(table: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x.combine_chunks() if x.num_chunks != 1 else x.chunk(0) for x in table.columns], names=table.column_names)
