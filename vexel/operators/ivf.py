"""Cluster-pruned search: k-means centroids, rows partitioned by their nearest one, and scans of the probed ones alone.

The centroids are the model: k times dimensions numbers, held by the driver and sent to all tasks, within MODEL_BYTES.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels, vectors
from ..functions.ranges import running_sum
from . import knn

MODEL_BYTES = 64 << 20
#: Rows of the sample that the first centroids are drawn from, for each of them, and bytes of it; it has a row a centroid at least.
SAMPLE_EACH, SAMPLE_BYTES = 500, 256 << 20


#: How files of centroids begin, and the version that is written.
MAGIC, FORMAT = b"VXCE", 2


class TrainingError(ValueError):
    pass


@dataclass
class Centroids:
    vectors: np.ndarray
    metric: str = "l2"
    iterations: int = 0
    converged: bool = False
    initial_error: float = 0.0
    final_error: float = 0.0
    ids: list[int] = field(default_factory=list)

    def __post_init__(self):
        if self.vectors.nbytes > MODEL_BYTES:
            raise TrainingError(f"centroids of {self.vectors.nbytes} bytes; the model may have {MODEL_BYTES}")
        self.ids = self.ids or list(range(len(self.vectors)))

    def nearest(self, q: list[float], n_probe: int) -> list[int]:
        """The ids of the n_probe nearest centroids, nearest first."""
        at = kernels.best(kernels.distances(self.vectors, np.array(q, float), self.metric), np.array(self.ids), n_probe)
        return [self.ids[i] for i in at.tolist()]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, v.tolist()) for i, v in zip(self.ids, self.vectors)], "cluster_id int, vector array<double>")

    def to_bytes(self) -> bytes:
        """A header, ids and elements, little-endian, and a checksum."""
        k, d = self.vectors.shape
        head = MAGIC + struct.pack("<HHII", FORMAT, list(vectors.METRICS).index(self.metric), k, d)
        body = head + np.array(self.ids, "<i4").tobytes() + self.vectors.astype("<f8").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Centroids:
        """Reads the present format, and 1, which had no ids and elements of 32 bits."""
        if len(data) < 20 or data[:4] != MAGIC:
            raise TrainingError("not centroids")
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise TrainingError("centroids that were damaged")
        version, metric, k, d = struct.unpack_from("<HHII", data, 4)
        if version not in (1, FORMAT):
            raise TrainingError(f"centroids of version {version}")
        name, at = list(vectors.METRICS)[metric], 16
        ids = np.frombuffer(data, "<i4", k, at).tolist() if version > 1 else list(range(k))
        at += 4 * k if version > 1 else 0
        return cls(np.frombuffer(data, "<f8" if version > 1 else "<f4", k * d, at).astype(float).reshape(k, d), name, ids=ids)

    @classmethod
    def from_table(cls, df: DataFrame, metric: str = "l2") -> Centroids:
        rows = df.orderBy("cluster_id").collect()
        if not rows:
            raise TrainingError("no centroids")
        if len({len(r.vector) for r in rows}) != 1:
            raise TrainingError("centroids of unlike dimensions")
        return cls(np.array([r.vector for r in rows], float), metric, ids=[r.cluster_id for r in rows])


def nearest_center(x: np.ndarray, centers: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest centroid of each row (the least of equally near ones), and the distance to it."""
    least, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, q in enumerate(centers):
        d = kernels.distances(x, q, metric)
        nearer = d < least
        least[nearer], which[nearer] = d[nearer], i
    return which, least


def assign(corpus: DataFrame, c: Centroids) -> DataFrame:
    """Adds cluster_id of the nearest centroid (the least of equally near ones) and centroid_distance. No shuffle."""
    corpus = corpus.drop("cluster_id", "centroid_distance")
    names, at = corpus.columns, corpus.columns.index("embedding")
    schema = T.StructType([*corpus.schema.fields, T.StructField("cluster_id", T.IntegerType()), T.StructField("centroid_distance", T.DoubleType())])
    centers, ids, metric = c.vectors, np.array(c.ids, np.int32), c.metric

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        which, least = nearest_center(kernels.matrix(b.column(at)), centers, metric)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[which]), pa.array(least)], names=[*names, "cluster_id", "centroid_distance"])

    return kernels.over_batches(corpus, run, schema)


def cluster_sums(assigned: DataFrame) -> DataFrame:
    """(cluster_id, n, error, sums): rows, summed squared distance to the centroid (0 where it isn't known) and summed vector of each
    cluster. A task hands on a row a cluster."""
    known = "centroid_distance" in assigned.columns
    rows = assigned.select(F.col("cluster_id").cast("int"), "embedding", F.col("centroid_distance") if known else F.lit(0.0).alias("centroid_distance"))
    return summed(rows, lambda b: (b.column(0).to_numpy(), kernels.matrix(b.column(1)), b.column(2).to_numpy()))


def nearest_sums(corpus: DataFrame, c: Centroids) -> DataFrame:
    """cluster_sums() of the rows by their nearest centroids. One kernel does both, so a task has one Python worker."""
    centers, ids, metric = c.vectors, np.array(c.ids, np.int32), c.metric

    def assigned(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = kernels.matrix(b.column(0))
        which, least = nearest_center(x, centers, metric)
        return ids[which], x, least

    return summed(corpus.select("embedding"), assigned)


def summed(rows: DataFrame, read) -> DataFrame:
    """(cluster_id, n, error, sums), by what read() makes of a batch: cluster, vector and distance of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, x, d = read(b)
            own, at = np.unique(ids, return_inverse=True)
            sums = np.zeros((len(own), x.shape[1]))
            np.add.at(sums, at, x)
            for c, n, e, v in zip(own.tolist(), np.bincount(at).tolist(), np.bincount(at, weights=d * d).tolist(), sums):
                t = total.setdefault(c, [0, 0.0, 0.0])
                t[0], t[1], t[2] = t[0] + n, t[1] + e, t[2] + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1] for t in total.values()]), pa.array([t[2].tolist() for t in total.values()], pa.list_(pa.float64()))], names=["cluster_id", "n", "error", "sums"])

    parts = rows.mapInArrow(run, "cluster_id int, n long, error double, sums array<double>")
    each = parts.select("cluster_id", "n", "error", F.posexplode("sums").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("n").alias("n"), F.sum("error").alias("error"), F.sum("x").alias("x"))
    return each.groupBy("cluster_id").agg(F.max("n").alias("n"), F.max("error").alias("error"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("sums"))


def means(assigned: DataFrame) -> DataFrame:
    """(cluster_id, i, value): the mean vector of each cluster, an element a row."""
    return cluster_sums(assigned).select("cluster_id", "n", F.posexplode("sums").alias("i", "x")).select("cluster_id", "i", (F.col("x") / F.col("n")).alias("value"))


def inertia(assigned: DataFrame) -> float:
    """Mean squared distance to the nearest centroid."""
    return assigned.agg(F.avg(F.col("centroid_distance") * F.col("centroid_distance"))).first()[0] or 0.0


def lloyd(corpus: DataFrame, c: Centroids, max_iter: int = 25, tol: float = 1e-4) -> Centroids:
    """Lloyd's iterations from given centroids; a cluster that gets no row keeps its centroid. A round reads the corpus once and
    returns a row a cluster, with its sums and error. Ends when no centroid moves, or the error changes by less than tol."""
    error, centers = None, c.vectors.copy()
    first, rounds, converged, place = None, 0, False, {k: i for i, k in enumerate(c.ids)}
    rows_of = corpus.select("embedding")

    def round_(centers: np.ndarray) -> tuple[np.ndarray, float]:
        now, n, total = centers.copy(), 0, 0.0
        for r in nearest_sums(rows_of, Centroids(centers, c.metric, ids=c.ids)).collect():
            now[place[r.cluster_id]] = np.array(r.sums) / r.n
            n, total = n + r.n, total + r.error
        return now, total / n if n else 0.0

    for rounds in range(1, max_iter + 1):  # noqa: B007
        now, new = round_(centers)
        first = new if first is None else first
        converged = bool((now == centers).all()) or (error is not None and abs(error - new) <= tol * max(error, 1e-300))
        error, centers = new, now
        if converged:
            break
    return Centroids(centers, c.metric, rounds, converged, first or 0.0, inertia(assign(rows_of, Centroids(centers, c.metric, ids=c.ids))), c.ids)


def train(corpus: DataFrame, n_clusters: int, max_iter: int = 25, tol: float = 1e-4, seed: int = 0, metric: str = "l2") -> Centroids:
    """k-means++ on a sample of SAMPLE_EACH rows a cluster at most (those with the least seeded hash of the id), then lloyd() on all."""
    n, least, most = corpus.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n_clusters < 1 or n < n_clusters:
        raise TrainingError(f"{n} rows for {n_clusters} clusters")
    if least != most:
        raise TrainingError(f"vectors of dimensions {least} and {most}")
    size = max(n_clusters, min(n_clusters * SAMPLE_EACH, SAMPLE_BYTES // (8 * max(1, most))))
    sample = corpus.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(size).select("embedding").collect()
    x, rng = np.array([r.embedding for r in sample], float), np.random.default_rng(seed)
    chosen = [x[int(rng.integers(len(x)))]]
    nearest2 = kernels.distances(x, chosen[0], metric) ** 2
    while len(chosen) < n_clusters:
        sums = np.cumsum(nearest2)
        at = int(np.searchsorted(sums, rng.random() * sums[-1])) if sums[-1] > 0 else int(rng.integers(len(x)))
        chosen.append(x[min(at, len(x) - 1)])
        nearest2 = np.minimum(nearest2, kernels.distances(x, chosen[-1], metric) ** 2)
    return lloyd(corpus, Centroids(np.array(chosen), metric), max_iter, tol)


def evenly_seeded(corpus: DataFrame, k: int, metric: str = "cosine") -> Centroids:
    """The rows at places i * (n / k) in the order of ids as centroids: a start without chance. k is at most n."""
    n = corpus.count()
    if not n:
        raise TrainingError("no rows")
    k = min(k, n)
    step = n // k
    # a global rank without a task that sees all rows; k ids come to the driver
    ids = corpus.select("id").orderBy("id").rdd.zipWithIndex().filter(lambda x: x[1] % step == 0 and x[1] // step < k).map(lambda x: x[0].id).collect()
    rows = {r.id: r.embedding for r in corpus.where(F.col("id").isin(ids)).select("id", "embedding").collect()}
    return Centroids(np.array([rows[i] for i in ids], float), metric)


def cluster_sizes(assigned: DataFrame, c: Centroids | None = None) -> DataFrame:
    """(cluster_id, n); with centroids also the empty ones."""
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    if c is None:
        return sizes
    return c.table(assigned.sparkSession).select("cluster_id").join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_stats(assigned: DataFrame, c: Centroids) -> DataFrame:
    """One row: clusters, rows, mean size, population variance of the sizes, empty clusters."""
    return cluster_sizes(assigned, c).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("total"), F.avg("n").alias("avg_size"), F.var_pop("n").alias("variance"), F.count_if(F.col("n") == 0).alias("n_empty"))


def search(assigned: DataFrame, c: Centroids, q: list[float], k: int, n_probe: int = 10) -> DataFrame:
    """The k nearest rows of the n_probe nearest clusters. The ids of the clusters are constants of the plan, so that a table
    partitioned by cluster_id is read at those partitions only."""
    return knn.nearest(assigned, q, k, c.metric, where=F.col("cluster_id").isin(c.nearest(q, n_probe)))


def search_batch(assigned: DataFrame, c: Centroids, queries: DataFrame, k: int, n_probe: int = 10) -> DataFrame:
    """(query_id, rank, id, distance, score). The scan has the clusters that any query probes; a row is compared with the
    queries that probe its cluster. Many queries meet those rows in pairs of blocks."""
    few, schema = knn.collect_queries(queries), knn.found_schema(assigned, queries)
    rows = assigned.select("id", "embedding", "cluster_id")
    if few is not None:
        ids, qs = few
        probes = [set(c.nearest(q.tolist(), n_probe)) for q in qs]
        wanted = sorted(set().union(*probes)) if probes else []

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return kernels.one_batch(kernels.rank_batch(kernels.ids_of(b.column(0)), kernels.matrix(b.column(1)), ids, qs, k, c.metric, allowed(probes, b.column(2).to_numpy())))

        found = kernels.over_batches(rows.where(F.col("cluster_id").isin(wanted)), run, schema)
    else:
        probed = lambda a: [set(c.nearest(q.tolist(), n_probe)) for q in kernels.matrix(a.column("q"))]
        found = knn.pairs_of_blocks(rows, queries.select("query_id", "q"), k, c.metric, schema, lambda a, b: allowed(probed(a), b.column("cluster_id").to_numpy()))
    out = knn.top_k_each(found, "query_id", [F.col("distance"), F.col("id")], k)
    return out.select("query_id", "rank", "id", "distance", vectors.score("distance").alias("score"))


def allowed(probes: list[set[int]], clusters: np.ndarray) -> np.ndarray:
    return np.array([np.isin(clusters, [*p]) for p in probes]).reshape(len(probes), len(clusters))


def retrain(corpus: DataFrame, n_clusters: int, **options) -> tuple[Centroids, DataFrame]:
    c = train(corpus, n_clusters, **options)
    return c, assign(corpus, c)


def add_clusters(corpus: DataFrame, c: Centroids, n: int, **options) -> tuple[Centroids, DataFrame]:
    if n < 1:
        raise TrainingError("no clusters to add")
    return retrain(corpus, len(c.ids) + n, metric=c.metric, **options)


def optimize(corpus: DataFrame, c: Centroids, **options) -> tuple[Centroids, DataFrame, float]:
    """Trains anew; the third value is by how much the variance of the cluster sizes fell (0 if it didn't)."""
    before = cluster_stats(assign(corpus, c), c).first().variance or 0.0
    new, assigned = retrain(corpus, len(c.ids), metric=c.metric, **options)
    after = cluster_stats(assigned, new).first().variance or 0.0
    return new, assigned, max(0.0, before - after)


def balance(assigned: DataFrame, c: Centroids, threshold: float) -> DataFrame:
    """Rows of clusters larger than (1 + threshold) times the mean move on to their second nearest centroid, the farthest
    first, ties by id, as many as the cluster is over that size. Adds moved. threshold lies between 0 and 1. Ranks are running
    counts over ranges of the distance, so no cluster's rows have to meet in a task; the moved rows are assigned in one pass."""
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    sizes = {r.cluster_id: r.n for r in cluster_sizes(assigned, c).collect()}
    limit = int(sum(sizes.values()) / max(1, len(sizes)) * (1 + threshold))
    over = {k: n - limit for k, n in sizes.items() if n > limit}
    if not over or len(c.ids) < 2:
        return assigned.withColumn("moved", F.lit(False))
    hot = assigned.where(F.col("cluster_id").isin([*over])).select("id", "cluster_id", "centroid_distance")
    # distances are counted first; rows at the distance where a cluster's count is reached are ranked by id
    counts = hot.groupBy("cluster_id", "centroid_distance").agg(F.count("*").alias("_n")).withColumn("_far", -F.col("centroid_distance"))
    counts = running_sum(counts, "_far", "_n", "_upto", "_all", by="cluster_id")
    most = F.element_at(F.create_map(*[F.lit(x) for kv in over.items() for x in kv]), F.col("cluster_id"))
    counts = counts.select("cluster_id", "centroid_distance", F.when(F.col("_upto") <= most, F.col("_n")).otherwise(F.greatest(F.lit(0), most - (F.col("_upto") - F.col("_n")))).alias("_take"), "_n").where("_take > 0")
    whole = counts.where("_take = _n").select("cluster_id", "centroid_distance")
    leaving = hot.join(whole, ["cluster_id", "centroid_distance"], "left_semi").select("id", "cluster_id")
    cut = hot.join(counts.where("_take < _n").select("cluster_id", "centroid_distance", "_take"), ["cluster_id", "centroid_distance"]).withColumn("_one", F.lit(1).cast("long"))
    cut = running_sum(cut, "id", "_one", "_rank", "_all", by="cluster_id").where("_rank <= _take").select("id", "cluster_id")
    marked = assigned.join(leaving.union(cut).withColumn("moved", F.lit(True)), ["id", "cluster_id"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    return second_nearest(marked.select(*assigned.columns, "moved"), c)


def second_nearest(rows: DataFrame, c: Centroids) -> DataFrame:
    """rows (moved, cluster_id, centroid_distance, embedding, ...): moved ones get the nearest centroid but their own."""
    names = rows.columns
    at = {n: names.index(n) for n in ("embedding", "cluster_id", "centroid_distance", "moved")}
    centers, ids, metric = c.vectors, np.array(c.ids, np.int32), c.metric

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = kernels.matrix(b.column(at["embedding"]))
        own, d = b.column(at["cluster_id"]).to_numpy().copy(), b.column(at["centroid_distance"]).to_numpy().copy()
        go = np.flatnonzero(b.column(at["moved"]).to_numpy(zero_copy_only=False))
        least, which = np.full(len(go), np.inf), own[go].copy()
        for i, q in enumerate(centers):
            far = np.where(own[go] == ids[i], np.inf, kernels.distances(x[go], q, metric))
            nearer = far < least
            least[nearer], which[nearer] = far[nearer], ids[i]
        own[go], d[go] = which, least
        cols = list(b.columns)
        cols[at["cluster_id"]], cols[at["centroid_distance"]] = pa.array(own, pa.int32()), pa.array(d)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return kernels.over_batches(rows, run, rows.schema)


def cluster_evenly(corpus: DataFrame, k: int, max_iter: int = 20, metric: str = "cosine") -> tuple[Centroids, DataFrame]:
    """Clusters without chance: evenly seeded, at most max_iter rounds; clusters without rows are left out."""
    c = lloyd(corpus, evenly_seeded(corpus, k, metric), max_iter, tol=0.0)
    assigned = assign(corpus, c)
    there = sorted(r.cluster_id for r in assigned.select("cluster_id").distinct().collect())
    kept = [c.ids.index(i) for i in there]
    return Centroids(c.vectors[kept], metric, c.iterations, c.converged, c.initial_error, c.final_error, there), assigned


def pq_train(corpus: DataFrame, subspaces: int, centroids: int, iterations: int = 10, seed: int = 0) -> list[list[list[float]]]:
    """A codebook for vectors.pq_encode(): k-means of each subspace over all rows. centroids is cut to the number of rows."""
    n, dimensions = corpus.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return []
    k, book = min(centroids, n), []
    for first, length in vectors.pq_split(dimensions, subspaces):
        part = corpus.select("id", F.slice("embedding", first + 1, length).alias("embedding"))
        book.append(train(part, k, max_iter=iterations, tol=0.0, seed=seed).vectors.tolist())
    return book


def pq_encode(corpus: DataFrame, book: list[list[list[float]]], embedding: str = "embedding") -> DataFrame:
    """Adds codes: for each subspace the number of the nearest of its centroids (ties to the smaller). The codebook goes to the tasks
    once, so a plan doesn't grow with it; no shuffle."""
    corpus = corpus.drop("codes")
    names, at = corpus.columns, corpus.columns.index(embedding)
    centers = [np.array(b, float) for b in book]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x, first, codes = kernels.matrix(b.column(at)), 0, []
        for c in centers:
            part = x[:, first : first + c.shape[1]]
            first += c.shape[1]
            least, which = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
            for i, q in enumerate(c):
                d = kernels.distances(part, q, "l2")
                nearer = d < least
                least[nearer], which[nearer] = d[nearer], i
            codes.append(which)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.stack(codes, axis=1).tolist(), pa.list_(pa.int32()))], names=[*names, "codes"])

    return kernels.over_batches(corpus, run, T.StructType([*corpus.schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType()))]))


def balance_report(assigned: DataFrame, c: Centroids, threshold: float = 0.5) -> DataFrame:
    """One row: the largest and smallest cluster over the mean size, clusters beyond (1 + threshold) times it, and whether
    balancing is called for."""
    mean = F.avg("n")
    sizes = cluster_sizes(assigned, c)
    limit = sizes.agg((mean * (1 + threshold)).alias("limit"))
    out = sizes.crossJoin(limit).agg((F.max("n") / mean).alias("largest"), (F.min("n") / mean).alias("smallest"), F.count_if(F.col("n") > F.col("limit")).alias("n_over"))
    return out.withColumn("needed", F.col("n_over") > 0)


def weighted_draw(weights: DataFrame, share: float, weight: str = "weight", order: str = "id") -> DataFrame:
    """The first row at which the running sum of weights reaches share of their total. Sums of ranges of the order are
    added first, so that no task runs over all rows."""
    rows = running_sum(weights, order, weight, "_upto", "_all")
    return rows.where(F.col("_upto") >= F.lit(share) * F.col("_all")).orderBy(order).limit(1).select(*weights.columns)
