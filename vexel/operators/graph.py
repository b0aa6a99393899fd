"""A navigable graph as an edge table: (src, dst, distance), with layers where it is searched; and its statistics."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, vectors
from . import knn


def knn_graph(corpus: DataFrame, m: int, metric: str = "l2", sources: DataFrame | None = None) -> DataFrame:
    """Edges from every row, or from those of sources alone, to its m nearest others."""
    queries = (corpus if sources is None else sources).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    found = knn.nearest_batch(corpus, queries, m + 1, metric).where("query_id <> id")
    return knn.top_k_each(found.drop("rank"), "query_id", [F.col("distance"), F.col("id")], m).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")


def prune(edges: DataFrame, m: int) -> DataFrame:
    """The m shortest edges of each node."""
    return knn.top_k_each(edges, "src", [F.col("distance"), F.col("dst")], m).drop("rank")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance").distinct()


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One hop: (id) to the ids that its edges lead to."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and mean degree of the undirected graph."""
    pairs = undirected(edges)
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return ends.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("avg_degree"))


def level_distribution(levels: DataFrame) -> DataFrame:
    """levels (id, level): a node of level L is in the layers 0 to L. (layer, n)."""
    return levels.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))


def level(id_: str | Column, m: int, seed: int = 0) -> Column:
    """The highest layer of a row, by a hash of its id: a layer has one row in m of the one below."""
    share = (F.xxhash64(F.lit(seed), id_) / F.lit(2.0**64)) + 0.5
    return F.floor(-F.log(F.greatest(share, F.lit(1e-12))) / F.log(F.lit(float(m)))).cast("int")


def build(corpus: DataFrame, m: int = 16, metric: str = "l2", seed: int = 0) -> DataFrame:
    """(layer, src, dst, distance): in each layer every row of it has edges to the m nearest others there (2 m in layer 0), and those
    rows edges back, cut to twice as many. Layers are few, each m times smaller than the one before; a layer of m rows at most is
    the last."""
    rows, out, layer = corpus.select("id", "embedding").withColumn("level", level("id", m, seed)), None, 0
    while True:
        here = rows.where(F.col("level") >= layer).select("id", "embedding")
        n = here.count()
        if n < 2:
            break
        own = min(n - 1, m if layer else 2 * m)
        edges = knn_graph(here, own, metric)
        both = prune(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct(), 2 * own)
        both = both.select(F.lit(layer).alias("layer"), "src", "dst", "distance")
        out = both if out is None else out.unionByName(both)
        if n <= m:
            break
        layer += 1
    if out is None:
        kind = corpus.schema["id"].dataType.simpleString()
        out = corpus.sparkSession.createDataFrame([], f"layer int, src {kind}, dst {kind}, distance double")
    return out


def entry_points(edges: DataFrame, n: int) -> list:
    """Rows of the highest layer, n at most, by id."""
    top = edges.agg(F.max("layer")).first()[0]
    return [] if top is None else [r.src for r in edges.where(F.col("layer") == top).select("src").distinct().orderBy("src").limit(n).collect()]


def search(edges: DataFrame, corpus: DataFrame, q: list[float], k: int, ef: int = 64, metric: str = "l2", starts: int = 16, most_steps: int = 64) -> DataFrame:
    """About the k nearest rows (id, distance, score) to one vector, as search_batch() finds them."""
    return search_batch(edges, corpus, {0: q}, k, ef, metric, starts, most_steps).drop("query_id").orderBy("distance", "id")


def search_batch(edges: DataFrame, corpus: DataFrame, queries: dict[int, list[float]], k: int, ef: int = 64, metric: str = "l2", starts: int = 16, most_steps: int = 64) -> DataFrame:
    """About the k nearest rows (query_id, id, distance, score) to each of some queries: a beam of the ef nearest rows known goes along
    the edges, layer by layer, until none of it has a neighbour that is nearer. The beams go in step: a step reads once the edges, and
    once the vectors, of the ef rows a query at most that it opens, so no step scans for more than ef times 4 m ids a query, and the
    driver holds those it has met. Both tables should be clustered by id (src), so that the scan skips by statistics."""
    spark, names, ef = corpus.sparkSession, [*queries], max(ef, k)
    vectors_of = [np.array(q, float) for q in queries.values()]
    known: dict = {}  # distances of a row to all queries

    def measure(ids: set) -> None:
        new = [i for i in ids if i not in known]
        if new:
            rows = corpus.where(F.col("id").isin(new)).select("id", "embedding").collect()
            x = np.array([r.embedding for r in rows], float)
            known.update(zip([r.id for r in rows], np.array([kernels.distances(x, q, metric) for q in vectors_of]).T.tolist() if rows else []))

    def nearest(n: int, ids, j: int) -> list:
        return heapq.nsmallest(n, [i for i in ids if i in known], key=lambda i: (known[i][j], i))

    top = edges.agg(F.max("layer")).first()[0]
    first = entry_points(edges, starts)
    measure({*first})
    beams = [first for _ in names]
    for layer in range(-1 if top is None else top, -1, -1):
        width, links = ef if layer == 0 else min(ef, starts), {}
        beams = [nearest(width, b, j) for j, b in enumerate(beams)]
        opened: list[set] = [set() for _ in names]
        for _ in range(most_steps):
            new = [[i for i in b if i not in o] for b, o in zip(beams, opened)]
            unread = {i for n in new for i in n if i not in links}
            if not any(new):
                break
            if unread:
                links.update({i: [] for i in unread})
                for r in edges.where((F.col("layer") == layer) & F.col("src").isin([*unread])).select("src", "dst").collect():
                    links[r.src].append(r.dst)
            found = [{d for i in n for d in links[i]} for n in new]
            measure(set().union(*found))
            for j, n in enumerate(new):
                if n:
                    opened[j].update(n)
                    beams[j] = nearest(width, {*beams[j], *found[j]}, j)
    best = [(name, i, known[i][j]) for j, name in enumerate(names) for i in nearest(k, beams[j], j)]
    kind = corpus.schema["id"].dataType.simpleString()
    return spark.createDataFrame(best, f"query_id {'string' if names and isinstance(names[0], str) else 'long'}, id {kind}, distance double").withColumn("score", vectors.score("distance"))


def insert(edges: DataFrame, corpus: DataFrame, new: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """Edges (of one layer) with new rows: each gets edges to its m nearest of the old and new rows, and they edges back; every row
    keeps its m shortest."""
    both = corpus.select("id", "embedding").unionByName(new.select("id", "embedding"))
    queries = new.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    found = knn.nearest_batch(both, queries, m + 1, metric).where("query_id <> id")
    own = knn.top_k_each(found.drop("rank"), "query_id", [F.col("distance"), F.col("id")], m).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")
    back = own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")
    return prune(edges.select("src", "dst", "distance").unionByName(own).unionByName(back).distinct(), m)


def remove(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those from and to rows that are gone (id)."""
    ids = gone.select(F.col("id").alias("_gone"))
    return edges.join(ids, edges["src"] == ids["_gone"], "left_anti").join(ids, F.col("dst") == ids["_gone"], "left_anti")
