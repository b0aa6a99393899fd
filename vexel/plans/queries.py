"""The engine's queries over the driver's tables, each with DuckDB SQL that gives the same rows.

A corpus row is an embedding, with the event of the same number as its metadata where a query uses that. Distances are rounded to six digits.
Queries read whole tables. Query vectors are those of the rows with the smallest ids, which is what Q stands for in SQL.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.filters import Compiler, compile_filter
from ..operators import dml, graph, hybrid, ivf, knn, rank, stats
from ..sources import store
from ..streaming import streams
from .workers import on_workers

AS_OF = "2024-01-31 00:00:00"
K, N_CLUSTERS = 10, 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = f"""WITH c AS (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS embedding, e.label, v.event_type, v.value, v.user_id, CAST(json_extract(v.props, '$.k') AS INT) AS k,
  TIMESTAMP '{AS_OF}' - to_hours(((e.vec_id * 37) % 720)::INT) AS ts FROM embeddings e JOIN events v ON e.vec_id = v.event_id),
q AS (SELECT id AS query_id, embedding AS q FROM c WHERE id < 5), q0 AS (SELECT embedding AS q FROM c WHERE id = 0),
d AS (SELECT c.*, list_distance(c.embedding, q0.q) AS distance, list_cosine_similarity(c.embedding, q0.q) AS sim FROM c, q0)
"""


#: Schemas of the tables that the query at work has opened: their footers are read once in a query.
_OPENED = threading.local()


def query(name: str, sql: str | None = None, base: bool = True):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            on_workers(spark)
            _OPENED.schemas = {}
            try:
                return fn(spark, sf)
            finally:
                _OPENED.schemas = None

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (BASE if base else "") + sql
        return run

    return add


def r6(x: Column | str) -> Column:
    return F.round(vectors.col(x), 6)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path, known = f"{sf}/{name}.parquet", getattr(_OPENED, "schemas", None)
    if known is None:
        return spark.read.parquet(path)
    if path in known:
        return spark.read.schema(known[path]).parquet(path)
    out = spark.read.parquet(path)
    known[path] = out.schema
    return out


def corpus(spark: SparkSession, sf: str, metadata: bool = False, fields: bool = False) -> DataFrame:
    """(id, embedding, label, ts); with fields also event_type, value, user_id and k of the event of the same number, and with
    metadata those and the same as a VARIANT document. Only queries that use the event join it."""
    e = table(spark, sf, "embeddings")
    ts = F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=((F.col("vec_id") * 37) % 720).cast("int"))
    own = [F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label", ts.alias("ts")]
    if not fields and not metadata:
        return e.select(*own)
    v = table(spark, sf, "events")
    out = e.join(v.drop("ts"), e.vec_id == v.event_id).select(*own, "event_type", "value", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    if not metadata:
        return out
    doc = F.struct(
        F.col("event_type").alias("category"), F.col("value").alias("views"), (F.col("value") > 100).alias("featured"),
        F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tags"), F.struct(F.col("user_id").alias("id"), F.col("k").cast("long").alias("k")).alias("user"),
    )
    return out.withColumn("metadata", F.to_variant_object(doc))


def q_of(spark: SparkSession, sf: str, id_: int = 0) -> list[float]:
    return knn.vector_of(corpus(spark, sf), id_)


def queries_of(c: DataFrame, n: int = 5) -> DataFrame:
    return c.where(F.col("id") < n).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", r6("distance").alias("distance"), r6("score").alias("score"), *more)


FOUND = "id, round(distance, 6) + 0.0 AS distance, round(1 / (1 + distance), 6) AS score"

# --- vector functions


def against(spark, sf):
    """Every row with the vector of row 0 as q."""
    c = corpus(spark, sf)
    return c.withColumn("q", knn.literal(q_of(spark, sf)))


def scalar(name: str, spark_expr: Callable[[], Column], sql: str) -> None:
    @query(name, f"SELECT id, round(({sql})::DOUBLE, 6) + 0.0 AS v FROM c, q0")
    def run(spark, sf):
        return against(spark, sf).select("id", r6(spark_expr()).alias("v"))


DOT, NA, NB = "list_inner_product(embedding, q)", "sqrt(list_inner_product(embedding, embedding))", "sqrt(list_inner_product(q, q))"
scalar("vec_dimension", lambda: vectors.dimension("embedding").cast("double"), "len(embedding)")
scalar("vec_norm", lambda: vectors.magnitude("embedding"), NA)
scalar("vec_dot", lambda: vectors.dot("embedding", "q"), DOT)
scalar("vec_cosine", lambda: vectors.cosine("embedding", "q"), f"{DOT} / ({NA} * {NB})")
scalar("vec_cosine_distance", lambda: vectors.cosine_distance("embedding", "q"), f"1 - {DOT} / ({NA} * {NB})")
scalar("vec_l2", lambda: vectors.euclidean("embedding", "q"), "list_distance(embedding, q)")
scalar("vec_angular", lambda: F.when(F.col("id") == 0, F.lit(0.0)).otherwise(vectors.angular_distance("embedding", "q")), f"CASE WHEN id = 0 THEN 0 ELSE acos(greatest(-1, least(1, {DOT} / ({NA} * {NB})))) END")
scalar("vec_ip_to_cosine", lambda: vectors.inner_product_to_cosine(vectors.dot("embedding", "q"), "embedding", "q"), f"{DOT} / ({NA} * {NB})")
scalar("vec_score", lambda: vectors.score(vectors.euclidean("embedding", "q")), "1 / (1 + list_distance(embedding, q))")
scalar("vec_element", lambda: vectors.element("embedding", 3), "embedding[4]")


@query("vec_normalize", f"SELECT id, i::INT AS i, round(embedding[i + 1] / {NA}, 6) + 0.0 AS v FROM c, range(64) r(i)")
def vec_normalize(spark, sf):
    return corpus(spark, sf).select("id", F.posexplode(vectors.normalize("embedding")).alias("i", "v")).select("id", "i", r6("v").alias("v"))


@query("vec_key", "SELECT id, sha256(id::VARCHAR) AS key, 'vec_' || left(sha256(id::VARCHAR), 8) AS display FROM c")
def vec_key(spark, sf):
    return corpus(spark, sf).select("id", vectors.vector_key("id").alias("key"), vectors.display_id("id").alias("display"))


# --- exact search


def found(name: str, sql: str):
    return query(name, sql)


@found("knn_l2", f"SELECT {FOUND} FROM d ORDER BY d.distance, id LIMIT {K}")
def knn_l2(spark, sf):
    c = corpus(spark, sf)
    return out(knn.nearest(c, q_of(spark, sf), K))


@found("knn_cosine", f"SELECT id, round(1 - sim, 6) + 0.0 AS distance, round(1 / (1 + (1 - sim)), 6) AS score FROM d ORDER BY 1 - sim, id LIMIT {K}")
def knn_cosine(spark, sf):
    c = corpus(spark, sf)
    return out(knn.nearest(c, q_of(spark, sf), K, "cosine"))


BATCH = "x AS (SELECT query_id, id, list_distance(embedding, q) AS distance FROM c, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM x)"


@found("knn_batch", f", {BATCH} SELECT query_id, rank, {FOUND} FROM r WHERE rank <= {K}")
def knn_batch(spark, sf):
    c = corpus(spark, sf)
    return knn.nearest_batch(c, queries_of(c), K).select("query_id", "rank", "id", r6("distance").alias("distance"), r6("score").alias("score"))


@found("knn_similar", f"SELECT id, round(1 - list_cosine_similarity(embedding, (SELECT embedding FROM c WHERE id = 7)), 6) + 0.0 AS distance FROM c ORDER BY 1 - list_cosine_similarity(embedding, (SELECT embedding FROM c WHERE id = 7)), id LIMIT {K}")
def knn_similar(spark, sf):
    return knn.find_similar(corpus(spark, sf), 7, K).select("id", r6("distance").alias("distance"))


@found("knn_threshold", f"SELECT {FOUND} FROM (SELECT * FROM d ORDER BY distance, id LIMIT {K}) WHERE 1 / (1 + distance) >= 0.45")
def knn_threshold(spark, sf):
    c = corpus(spark, sf)
    return out(knn.nearest(c, q_of(spark, sf), K, min_score=0.45))


@found("top_k_scores", f"SELECT id, value FROM c ORDER BY value DESC, id LIMIT {K}")
def top_k_scores(spark, sf):
    return knn.top_k(corpus(spark, sf, fields=True), F.col("value"), K).select("id", "value")


HISTORY = [1, 2, 3, 3]


@found("recommend", f", m AS (SELECT list(a ORDER BY i) AS q FROM (SELECT i, sum(embedding[i + 1] * (CASE WHEN id = 3 THEN 2 ELSE 1 END)) / 4 AS a FROM c, range(64) r(i) WHERE id IN (1, 2, 3) GROUP BY i)), x AS (SELECT id, 1 - list_cosine_similarity(embedding, m.q) AS distance FROM c, m WHERE id NOT IN (1, 2, 3)) SELECT id, round(distance, 6) + 0.0 AS distance FROM x ORDER BY x.distance, id LIMIT {K}")
def recommend(spark, sf):
    return knn.recommend(corpus(spark, sf), HISTORY, K).select("id", r6("distance").alias("distance"))


# --- filters: over the VARIANT document, and over typed columns

TYPED = {"category": ("event_type", "string"), "views": ("value", "double"), "user.id": ("user_id", "bigint"), "user.k": ("k", "int")}


def flt(name: str, f: dict, sql: str, dialect: str = "full", typed: bool = False) -> None:
    @query(name, f"SELECT id FROM c WHERE {sql}")
    def run(spark, sf):
        return corpus(spark, sf, metadata=not typed, fields=typed).where(compile_filter(f, dialect=dialect, typed=TYPED if typed else None)).select("id")


flt("flt_eq", {"category": "click"}, "event_type = 'click'")
flt("flt_bool", {"featured": True}, "value > 100")
flt("flt_in", {"category": {"$in": ["click", "view"]}}, "event_type IN ('click', 'view')")
flt("flt_gt", {"views": {"$gt": 100}}, "value > 100")
flt("flt_gte", {"user.k": {"$gte": 40}}, "k >= 40")
flt("flt_lt", {"views": {"$lt": 50.5}}, "value < 50.5")
flt("flt_lte", {"user.k": {"$lte": 40}}, "k <= 40")
flt("flt_between", {"user.k": {"$gte": 20, "$lt": 60}}, "k >= 20 AND k < 60")
flt("flt_and", {"$and": [{"category": "click"}, {"views": {"$gt": 20}}]}, "event_type = 'click' AND value > 20")
flt("flt_or", {"$or": [{"category": "click"}, {"user.k": {"$lt": 10}}]}, "event_type = 'click' OR k < 10")
flt("flt_implicit_and", {"category": "click", "featured": False}, "event_type = 'click' AND NOT value > 100")
flt("flt_nested", {"user.id": 13}, "user_id = 13")
flt("flt_array", {"tags": "click"}, "event_type = 'click'")
flt("flt_array_in", {"tags": {"$in": ["click"]}}, "false")
flt("flt_missing", {"absent.field": "x"}, "false")
flt("flt_kind", {"user.id": "13"}, "false")
flt("flt_empty_and", {"$and": []}, "true")
flt("flt_empty_or", {"$or": []}, "false")
flt("flt_all", {}, "true")
flt("flt_equality", {"category": "click", "tags": "click"}, "event_type = 'click'", dialect="equality")
flt("flt_typed", {"$and": [{"category": {"$in": ["click", "view"]}}, {"views": {"$gt": 20}}, {"user.k": {"$lt": 90}}]}, "event_type IN ('click', 'view') AND value > 20 AND k < 90", typed=True)


@query("flt_simple", "SELECT id FROM c WHERE event_type = 'click' AND value >= 20")
def flt_simple(spark, sf):
    return corpus(spark, sf, metadata=True).where(Compiler().simple({"category": "click"}, {"views": ("gte", 20)})).select("id")


@query("flt_recent", f"SELECT id FROM c WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def flt_recent(spark, sf):
    return corpus(spark, sf).where(hybrid.is_recent(AS_OF)).select("id")


@query("flt_valid", "SELECT id FROM c WHERE len(embedding) = 64")
def flt_valid(spark, sf):
    return corpus(spark, sf).where(vectors.valid_vector("embedding", 64)).select("id")


CLICK = {"category": "click"}


@found("knn_prefilter", f"SELECT {FOUND} FROM d WHERE event_type = 'click' ORDER BY d.distance, id LIMIT {K}")
def knn_prefilter(spark, sf):
    c = corpus(spark, sf, metadata=True)
    return out(hybrid.search_filtered(c, q_of(spark, sf), K, compile_filter(CLICK)))


@found("knn_prefilter_typed", f"SELECT {FOUND} FROM d WHERE event_type = 'click' ORDER BY d.distance, id LIMIT {K}")
def knn_prefilter_typed(spark, sf):
    c = corpus(spark, sf, fields=True)
    return out(hybrid.search_filtered(c, q_of(spark, sf), K, compile_filter(CLICK, typed=TYPED)))


@found("knn_postfilter", f", t AS (SELECT * FROM d ORDER BY distance, id LIMIT {3 * K}) SELECT {FOUND} FROM t WHERE event_type = 'click' ORDER BY t.distance, id LIMIT {K}")
def knn_postfilter(spark, sf):
    c = corpus(spark, sf, metadata=True)
    return out(hybrid.search_filtered(c, q_of(spark, sf), K, compile_filter(CLICK), mode="post"))


# --- clusters, with the mean of each label as centroid

IVF = """, m AS (SELECT label AS cluster_id, list_transform(range(64), lambda i: avg_i[i + 1]) AS vector FROM (SELECT label, list(a ORDER BY i) AS avg_i FROM (SELECT label, i, avg(embedding[i + 1]) AS a FROM c, range(64) r(i) GROUP BY label, i) GROUP BY label)),
p AS (SELECT id, embedding, cluster_id, list_distance(embedding, vector) AS cd FROM c, m),
a AS (SELECT id, embedding, cluster_id, cd FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cd, cluster_id) AS n FROM p) WHERE n = 1)
"""


def label_centroids(c: DataFrame) -> ivf.Centroids:
    rows = ivf.means(c.withColumn("cluster_id", F.col("label"))).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("vector"))
    return ivf.Centroids.from_table(rows)


def clustered(spark, sf) -> tuple[DataFrame, ivf.Centroids, DataFrame]:
    c = corpus(spark, sf)
    centroids = label_centroids(c)
    return c, centroids, ivf.assign(c, centroids)


@query("ivf_centroids", IVF + "SELECT cluster_id, i::INT AS i, round(vector[i + 1], 6) + 0.0 AS v FROM m, range(64) r(i)")
def ivf_centroids(spark, sf):
    return ivf.means(corpus(spark, sf).withColumn("cluster_id", F.col("label"))).select("cluster_id", "i", r6("value").alias("v"))


@query("ivf_assign", IVF + "SELECT id, cluster_id, round(cd, 6) + 0.0 AS distance FROM a")
def ivf_assign(spark, sf):
    return clustered(spark, sf)[2].select("id", "cluster_id", r6("centroid_distance").alias("distance"))


@query("ivf_cluster_sizes", IVF + "SELECT m.cluster_id, count(a.id) AS n FROM m LEFT JOIN a USING (cluster_id) GROUP BY m.cluster_id")
def ivf_cluster_sizes(spark, sf):
    _, c, a = clustered(spark, sf)
    return ivf.cluster_sizes(a, c)


@query("ivf_clusters_by_size", IVF + "SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id ORDER BY n DESC, cluster_id")
def ivf_clusters_by_size(spark, sf):
    return ivf.cluster_sizes(clustered(spark, sf)[2]).orderBy(F.desc("n"), "cluster_id")


@query("ivf_cluster_stats", IVF + ", s AS (SELECT m.cluster_id, count(a.id) AS n FROM m LEFT JOIN a USING (cluster_id) GROUP BY m.cluster_id) SELECT count(*) AS n_clusters, sum(n)::BIGINT AS total, round(avg(n), 6) AS avg_size, round(var_pop(n), 6) AS variance, count(*) FILTER (n = 0) AS n_empty FROM s")
def ivf_cluster_stats(spark, sf):
    _, c, a = clustered(spark, sf)
    return ivf.cluster_stats(a, c).select("n_clusters", "total", r6("avg_size").alias("avg_size"), r6("variance").alias("variance"), "n_empty")


@query("ivf_inertia", IVF + "SELECT round(avg(cd * cd), 6) AS v FROM a")
def ivf_inertia(spark, sf):
    return clustered(spark, sf)[2].agg(r6(F.avg(F.col("centroid_distance") * F.col("centroid_distance"))).alias("v"))


PROBES = ", pr AS (SELECT query_id, cluster_id FROM (SELECT query_id, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(q, vector), cluster_id) AS n FROM q, m) WHERE n <= 2), x AS (SELECT query_id, id, list_distance(embedding, q) AS distance FROM q JOIN pr USING (query_id) JOIN a USING (cluster_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM x)"


@query("ivf_probes", IVF + PROBES + " SELECT query_id, cluster_id FROM pr")
def ivf_probes(spark, sf):
    c, centroids, _ = clustered(spark, sf)
    return spark.createDataFrame([(r.query_id, k) for r in queries_of(c).collect() for k in centroids.nearest(list(r.q), 2)], "query_id long, cluster_id int")


@query("ivf_search_nprobe", IVF + PROBES + f" SELECT id, round(distance, 6) + 0.0 AS distance FROM r WHERE query_id = 0 AND rank <= {K}")
def ivf_search_nprobe(spark, sf):
    c, centroids, a = clustered(spark, sf)
    return ivf.search(a, centroids, q_of(spark, sf), K, n_probe=2).select("id", r6("distance").alias("distance"))


@query("ivf_batch_search", IVF + PROBES + f" SELECT query_id, rank, {FOUND} FROM r WHERE rank <= {K}")
def ivf_batch_search(spark, sf):
    c, centroids, a = clustered(spark, sf)
    return ivf.search_batch(a, centroids, queries_of(c), K, n_probe=2).select("query_id", "rank", "id", r6("distance").alias("distance"), r6("score").alias("score"))


@query("ivf_search_all", f"SELECT {FOUND} FROM d ORDER BY d.distance, id LIMIT {K}")
def ivf_search_all(spark, sf):
    c, centroids, a = clustered(spark, sf)
    return out(ivf.search(a, centroids, q_of(spark, sf), K, n_probe=len(centroids.ids)))


@query("recall_at_k", IVF + PROBES + f", f AS (SELECT query_id, id FROM r WHERE rank <= {K}), y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding, q), id) AS n FROM c, q), t AS (SELECT query_id, id FROM y WHERE n <= {K}), h AS (SELECT query_id, count(*) FILTER (f.id IS NOT NULL AND t.id IS NOT NULL) AS hits, count(f.id) AS nf, count(t.id) AS nt FROM f FULL JOIN t USING (query_id, id) GROUP BY query_id) SELECT round(avg(hits / least(nt, {K})), 6) AS recall, round(avg(CASE WHEN nf = 0 THEN 0 ELSE hits / nf END), 6) AS precision FROM h")
def recall_at_k(spark, sf):
    c, centroids, a = clustered(spark, sf)
    return knn.recall(ivf.search_batch(a, centroids, queries_of(c), K, n_probe=2), knn.nearest_batch(c, queries_of(c), K), K).select(r6("recall").alias("recall"), r6("precision").alias("precision"))


@query("ivf_lloyd_step", IVF + ", m2 AS (SELECT cluster_id, i, avg(embedding[i + 1]) AS v FROM a, range(64) r(i) GROUP BY cluster_id, i) SELECT cluster_id, i::INT AS i, round(v, 6) + 0.0 AS v FROM m2")
def ivf_lloyd_step(spark, sf):
    c, centroids, _ = clustered(spark, sf)
    moved = ivf.lloyd(c, centroids, max_iter=1)
    return moved.table(spark).select("cluster_id", F.posexplode("vector").alias("i", "v")).select("cluster_id", "i", r6("v").alias("v"))


@query("video_seeds", f", o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS total FROM c) SELECT id, (n // (total // {N_CLUSTERS}))::INT AS cluster_id FROM o WHERE n % (total // {N_CLUSTERS}) = 0 AND n // (total // {N_CLUSTERS}) < {N_CLUSTERS}")
def video_seeds(spark, sf):
    c = corpus(spark, sf)
    seeds = ivf.evenly_seeded(c, N_CLUSTERS)
    return knn.nearest_batch(c, seeds.table(spark).select(F.col("cluster_id").cast("long").alias("query_id"), F.col("vector").alias("q")), 1, "cosine").select("id", F.col("query_id").cast("int").alias("cluster_id"))


@query("ivf_train")
def ivf_train(spark, sf):
    c = corpus(spark, sf)
    return ivf.cluster_sizes(ivf.assign(c, ivf.train(c, N_CLUSTERS, max_iter=5)))


BALANCED = """, z AS (SELECT m.cluster_id, count(a.id) AS n FROM m LEFT JOIN a USING (cluster_id) GROUP BY m.cluster_id),
o AS (SELECT cluster_id, n - floor(l)::BIGINT AS over FROM z, (SELECT sum(n) / count(*) * 1.1 AS l FROM z) WHERE n > floor(l)),
t AS (SELECT a.*, row_number() OVER (PARTITION BY cluster_id ORDER BY cd DESC, id) <= over AS moved FROM a LEFT JOIN o USING (cluster_id)),
s2 AS (SELECT id, cluster_id, row_number() OVER (PARTITION BY id ORDER BY cd, cluster_id) AS n FROM p),
f AS (SELECT t.id, CASE WHEN moved THEN s2.cluster_id ELSE t.cluster_id END AS cluster_id, coalesce(moved, false) AS moved FROM t JOIN s2 ON t.id = s2.id AND s2.n = 2)
SELECT cluster_id, count(*) AS n, count(*) FILTER (moved) AS moved FROM f GROUP BY cluster_id"""


@query("ivf_balance", IVF + BALANCED)
def ivf_balance(spark, sf):
    _, centroids, a = clustered(spark, sf)
    return ivf.balance(a, centroids, 0.1).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


def rounds_sql(distance: str, rounds: int) -> str:
    """Lloyd's rounds from evenly spaced rows, and the clusters that they give."""
    d = {"l2": "list_distance(embedding, vector)", "cosine": "1 - list_cosine_similarity(embedding, vector)"}[distance]
    sql = f", o AS (SELECT id, embedding, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS total FROM c), m0 AS (SELECT (n // (total // {N_CLUSTERS}))::INT AS cluster_id, embedding AS vector FROM o WHERE n % (total // {N_CLUSTERS}) = 0 AND n // (total // {N_CLUSTERS}) < {N_CLUSTERS})"
    for r in range(rounds + 1):
        sql += f", a{r} AS (SELECT id, embedding, cluster_id FROM (SELECT id, embedding, cluster_id, row_number() OVER (PARTITION BY id ORDER BY {d}, cluster_id) AS n FROM c, m{r}) WHERE n = 1)"
        if r < rounds:
            sql += f", m{r + 1} AS (SELECT cluster_id, list(x ORDER BY i) AS vector FROM (SELECT cluster_id, i, avg(embedding[i + 1]) AS x FROM a{r}, range(64) r(i) GROUP BY cluster_id, i) GROUP BY cluster_id)"
    return sql + f" SELECT cluster_id, count(*) AS n FROM a{rounds} GROUP BY cluster_id"


@query("ivf_lloyd", rounds_sql("l2", 3))
def ivf_lloyd(spark, sf):
    """Training from a start without chance, three rounds."""
    c = corpus(spark, sf)
    return ivf.cluster_sizes(ivf.assign(c, ivf.lloyd(c, ivf.evenly_seeded(c, N_CLUSTERS, "l2"), max_iter=3, tol=0.0)))


@query("video_cluster_rounds", rounds_sql("cosine", 3))
def video_cluster_rounds(spark, sf):
    return ivf.cluster_sizes(ivf.cluster_evenly(corpus(spark, sf), N_CLUSTERS, max_iter=3)[1])


@query("video_cluster")
def video_cluster(spark, sf):
    return ivf.cluster_sizes(ivf.cluster_evenly(corpus(spark, sf), N_CLUSTERS)[1])


@query("balance_report", IVF + ", s AS (SELECT m.cluster_id, count(a.id) AS n FROM m LEFT JOIN a USING (cluster_id) GROUP BY m.cluster_id) SELECT round(max(n) / avg(n), 6) AS largest, round(min(n) / avg(n), 6) AS smallest, count(*) FILTER (n > (SELECT avg(n) * 1.1 FROM s)) AS n_over, count(*) FILTER (n > (SELECT avg(n) * 1.1 FROM s)) > 0 AS needed FROM s")
def balance_report(spark, sf):
    _, c, a = clustered(spark, sf)
    return ivf.balance_report(a, c, 0.1).select(r6("largest").alias("largest"), r6("smallest").alias("smallest"), "n_over", "needed")


@query("weighted_draw", ", w AS (SELECT id, sum(k) OVER (ORDER BY id) AS upto, sum(k) OVER () AS total FROM c) SELECT id FROM w WHERE upto >= 0.5 * total ORDER BY id LIMIT 1")
def weighted_draw(spark, sf):
    return ivf.weighted_draw(corpus(spark, sf, fields=True).select("id", "k"), 0.5, "k").select("id")


# --- quantization


@query("sq8_encode", ", s AS (SELECT id, embedding, list_min(embedding) AS lo, list_max(embedding) AS hi FROM c) SELECT id, i::INT AS i, round((embedding[i + 1] - lo) / (hi - lo) * 255)::INT AS code FROM s, range(64) r(i)")
def sq8_encode(spark, sf):
    return corpus(spark, sf).select("id", F.posexplode(vectors.sq8_encode("embedding")["data"]).alias("i", "code")).withColumn("code", F.col("code").cast("int"))


@query("sq8_roundtrip", ", s AS (SELECT id, embedding, list_min(embedding) AS lo, list_max(embedding) AS hi FROM c), e AS (SELECT id, max(abs(lo + round((embedding[i + 1] - lo) / (hi - lo) * 255) / 255 * (hi - lo) - embedding[i + 1])) AS err FROM s, range(64) r(i) GROUP BY id) SELECT id, round(err, 6) + 0.0 AS err FROM e")
def sq8_roundtrip(spark, sf):
    error = F.array_max(F.zip_with(vectors.sq8_decode(vectors.sq8_encode("embedding")), "embedding", lambda a, b: F.abs(a - b)))
    return corpus(spark, sf).select("id", r6(error).alias("err"))


def codebook(c: DataFrame, subspaces: int = 4, centroids: int = 8) -> list[list[list[float]]]:
    rows = [list(r.embedding) for r in c.where(F.col("id") < centroids).orderBy("id").collect()]
    return [[v[a : a + n] for v in rows] for a, n in vectors.pq_split(64, subspaces)]


@query("pq_encode", ", b AS (SELECT id AS code, embedding AS v FROM c WHERE id < 8), x AS (SELECT c.id, s, code, row_number() OVER (PARTITION BY c.id, s ORDER BY list_distance(c.embedding[s * 16 + 1 : s * 16 + 16], v[s * 16 + 1 : s * 16 + 16]), code) AS n FROM c, b, range(4) r(s)) SELECT id, s::INT AS subspace, code::INT AS code FROM x WHERE n = 1")
def pq_encode(spark, sf):
    c = corpus(spark, sf)
    return ivf.pq_encode(c, codebook(c)).select("id", F.posexplode("codes").alias("subspace", "code"))


@query("pq_error", ", b AS (SELECT id AS code, embedding AS v FROM c WHERE id < 8), x AS (SELECT c.id, s, min(list_distance(c.embedding[s * 16 + 1 : s * 16 + 16], v[s * 16 + 1 : s * 16 + 16])) AS e FROM c, b, range(4) r(s) GROUP BY c.id, s) SELECT id, round(sqrt(sum(e * e)), 6) + 0.0 AS err FROM x GROUP BY id")
def pq_error(spark, sf):
    c = corpus(spark, sf)
    book = codebook(c)
    return c.select("id", r6(vectors.euclidean(vectors.pq_decode(vectors.pq_encode("embedding", book, 64), book), "embedding")).alias("err"))


# --- tiers

RECENT = f"ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
TIERS = f", t AS ((SELECT *, 'recent' AS tier FROM d WHERE {RECENT} ORDER BY distance, id LIMIT {K}) UNION ALL (SELECT *, 'historical' AS tier FROM d WHERE NOT {RECENT} ORDER BY distance, id LIMIT {K}))"


@query("hybrid_search", TIERS + f" SELECT {FOUND}, tier FROM t ORDER BY t.distance, id LIMIT {K}")
def hybrid_search(spark, sf):
    c = corpus(spark, sf)
    return out(hybrid.search(c, q_of(spark, sf), K, AS_OF), "tier")


@query("hybrid_weighted", TIERS + f" SELECT id, round(distance, 6) + 0.0 AS distance, round(1 / (1 + distance) * (CASE WHEN tier = 'recent' THEN 1.5 ELSE 1 END), 6) AS score, tier FROM t ORDER BY 1 / (1 + t.distance) * (CASE WHEN tier = 'recent' THEN 1.5 ELSE 1 END) DESC, id LIMIT {K}")
def hybrid_weighted(spark, sf):
    c = corpus(spark, sf)
    return out(hybrid.search_weighted(c, q_of(spark, sf), K, AS_OF, recent_weight=1.5), "tier")


@query("hybrid_linear", TIERS + f" SELECT id, round((1 - distance) * (CASE WHEN tier = 'recent' THEN 1.5 ELSE 1 END), 6) + 0.0 AS score, tier FROM t ORDER BY (1 - t.distance) * (CASE WHEN tier = 'recent' THEN 1.5 ELSE 1 END) DESC, id LIMIT {K}")
def hybrid_linear(spark, sf):
    c = corpus(spark, sf)
    return hybrid.search_weighted(c, q_of(spark, sf), K, AS_OF, recent_weight=1.5, scoring="linear").select("id", r6("score").alias("score"), "tier")


@query("hybrid_plan", f"SELECT count(*) FILTER ({RECENT}) > 0 AS search_recent, count(*) FILTER (NOT {RECENT}) > 0 AS search_historical, (CASE WHEN count(*) < 1000 THEN 5 WHEN count(*) < 10000 THEN 10 ELSE 20 END)::INT AS n_probe, (CASE WHEN count(*) < 1000 THEN 50 WHEN count(*) < 10000 THEN 100 ELSE 200 END)::INT AS ef FROM c")
def hybrid_plan(spark, sf):
    n = stats.tier_counts(corpus(spark, sf), AS_OF).first()
    p = hybrid.plan_search(n.recent, n.historical)
    return spark.createDataFrame([tuple(p.values())], "search_recent boolean, search_historical boolean, n_probe int, ef int")


@query("tier_counts", f"SELECT count(*) FILTER ({RECENT}) AS recent, count(*) FILTER (NOT {RECENT}) AS historical, count(*) AS total FROM c")
def tier_counts(spark, sf):
    return stats.tier_counts(corpus(spark, sf), AS_OF)


AGE = f"(epoch(TIMESTAMP '{AS_OF}') - epoch(ts))"


@query("age_distribution", f"SELECT count(*) FILTER ({AGE} < 3600) AS last_hour, count(*) FILTER ({AGE} >= 3600 AND {AGE} < 86400) AS last_day, count(*) FILTER ({AGE} >= 86400 AND {AGE} < 604800) AS last_week, count(*) FILTER ({AGE} >= 604800) AS older, count(*) AS total, max(ts) AS newest, min(ts) AS oldest FROM c")
def age_distribution(spark, sf):
    return stats.age_distribution(corpus(spark, sf), AS_OF)


@query("avg_age", f"SELECT round(avg({AGE} * 1000), 3) AS avg_age_ms FROM c")
def avg_age(spark, sf):
    return stats.average_age_ms(corpus(spark, sf), AS_OF).select(F.round("avg_age_ms", 3).alias("avg_age_ms"))


BEFORE = "2024-01-28 00:00:00"


@query("migrate_delta", f"SELECT id FROM c WHERE ts > TIMESTAMP '{BEFORE}' - INTERVAL 7 DAY AND NOT {RECENT}")
def migrate_delta(spark, sf):
    return hybrid.migration(corpus(spark, sf), BEFORE, AS_OF).select("id")


@query("new_since", f"SELECT count(*) AS n FROM c WHERE ts > TIMESTAMP '{BEFORE}'")
def new_since(spark, sf):
    return stats.new_since(corpus(spark, sf), BEFORE)


@query("memory_estimate", "SELECT sum(len(embedding) * 4 + 41)::BIGINT AS bytes FROM c")
def memory_estimate(spark, sf):
    return stats.memory_estimate(corpus(spark, sf))


@query("health", f"SELECT count(*) FILTER ({RECENT}) AS recent, sum(len(embedding) * 4 + 41)::BIGINT AS bytes, CASE WHEN count(*) FILTER ({RECENT}) > 100 OR sum(len(embedding) * 4 + 41) >= 1073741824 THEN 'warning' ELSE 'ok' END AS status FROM c")
def health(spark, sf):
    return stats.health(corpus(spark, sf), AS_OF, most_recent=100)


# --- merging and scores

SETS = f", s0 AS (SELECT id, distance, 1 / (1 + distance) AS score, 0 AS source_idx FROM d ORDER BY distance, id LIMIT {K}), s1 AS (SELECT id, 1 - sim AS distance, 1 / (1 + (1 - sim)) AS score, 1 AS source_idx FROM d WHERE event_type <> 'click' ORDER BY 1 - sim, id LIMIT {K}), u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"


def result_sets(spark, sf) -> list[DataFrame]:
    c = corpus(spark, sf, fields=True)
    q = q_of(spark, sf)
    return [knn.nearest(c, q, K).select("id", "distance", "score"), knn.nearest(c, q, K, "cosine", where=F.col("event_type") != "click").select("id", "distance", "score")]


def merged(name: str, sql: str, **options) -> None:
    @query(name, SETS + sql)
    def run(spark, sf):
        return out(rank.merge(result_sets(spark, sf), K, **options))


TOP = f"SELECT id, round(distance, 6) + 0.0 AS distance, round(score, 6) + 0.0 AS score FROM g ORDER BY g.score DESC, id LIMIT {K}"
merged("merge_best", f", g AS (SELECT id, max(score) AS score, arg_max(distance, score * 1e9 - source_idx * 1e-9) AS distance FROM u GROUP BY id) {TOP}", strategy="best")
merged("merge_avg", f", g AS (SELECT id, avg(score) AS score, avg(distance) AS distance FROM u GROUP BY id) {TOP}", strategy="average")
merged("merge_weighted", f", w AS (SELECT *, CASE WHEN source_idx = 0 THEN 2.0 ELSE 1.0 END AS w FROM u), g AS (SELECT id, sum(score * w) / sum(w) AS score, sum(distance * w) / sum(w) AS distance FROM w GROUP BY id) {TOP}", strategy="weighted", weights=[2.0, 1.0])


@query("merge_dedup", SETS + f", g AS (SELECT id, min(distance) AS distance FROM u GROUP BY id) SELECT id, round(distance, 6) + 0.0 AS distance FROM g ORDER BY g.distance, id LIMIT {K}")
def merge_dedup(spark, sf):
    return rank.merge_search_results(result_sets(spark, sf), K).select("id", r6("distance").alias("distance"))


@query("union_all", SETS + " SELECT id, source_idx FROM u")
def union_all(spark, sf):
    return rank.union(result_sets(spark, sf)).select("id", "source_idx")


@query("set_difference", SETS + " SELECT id FROM s0 EXCEPT SELECT id FROM s1")
def set_difference(spark, sf):
    a, b = result_sets(spark, sf)
    return stats.orphans(a, b)


def rescored(name: str, score: Callable[[], Column], sql: str) -> None:
    @query(name, f"SELECT id, round({sql}, 6) + 0.0 AS score FROM (SELECT * FROM d ORDER BY distance, id LIMIT 50) ORDER BY {sql} DESC, id LIMIT {K}")
    def run(spark, sf):
        c = corpus(spark, sf, fields=True)
        return rank.rescore(knn.nearest(c, q_of(spark, sf), 50), score(), K).select("id", r6("score").alias("score"))


HALF = 7 * 86_400.0
DECAY, VIEWS = f"(1 - distance) * pow(0.5, {AGE} / 604800.0)", "(1 - distance) * (1 + ln(1 + value) / 10)"
rescored("score_similarity", rank.similarity, "1 - distance")
rescored("score_decay", lambda: rank.time_decayed(AS_OF, HALF, F.col("ts")), DECAY)
rescored("score_popularity", lambda: rank.popular(F.col("value")), VIEWS)
rescored("score_combined", lambda: rank.combined([(rank.similarity(), 2.0), (rank.time_decayed(AS_OF, HALF, F.col("ts")), 1.0), (rank.popular(F.col("value")), 1.0)]), f"((1 - distance) * 2 + {DECAY} + {VIEWS}) / 4")


@query("latency_stats", ", x AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT max(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM x")
def latency_stats(spark, sf):
    return stats.latency_stats(table(spark, sf, "events"), "value").select("n", r6("mean").alias("mean"), "p50", "p99")


@query("cache_stats", "SELECT count(*) FILTER (event_type = 'click') AS hits, count(*) FILTER (event_type <> 'click') AS misses, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS hit_rate FROM events")
def cache_stats(spark, sf):
    log = table(spark, sf, "events").select((F.col("event_type") == "click").alias("hit"))
    return stats.cache_stats(log).select("hits", "misses", r6("hit_rate").alias("hit_rate"))


@query("running_means", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id) + 1e-9, 6) AS mean FROM events", base=False)
def running_means(spark, sf):
    return stats.running_means(table(spark, sf, "events"), "value", "event_id", "event_type").select("event_id", r6(F.col("mean") + 1e-9).alias("mean"))


# --- changes


@query("insert_dedup", "SELECT CASE WHEN id % 2 = 0 THEN id ELSE -1 - id END AS id, CASE WHEN id % 2 = 0 THEN 'duplicate id' ELSE 'ok' END AS status FROM c")
def insert_dedup(spark, sf):
    """All rows exist; the batch has them again, every other one with an id that is new."""
    c = corpus(spark, sf).select("id", "embedding")
    good, bad = dml.split_insert(c, c.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1 - F.col("id"))), 64)
    return good.select("id", F.lit("ok").alias("status")).union(bad.select("id", F.col("reason").alias("status")))


DEAD = "id % 7 = 0"


@query("soft_delete", f"SELECT {FOUND} FROM d WHERE NOT {DEAD} ORDER BY d.distance, id LIMIT {K}")
def soft_delete(spark, sf):
    c = corpus(spark, sf)
    return out(knn.nearest(dml.active(c, c.where(DEAD).select("id")), q_of(spark, sf), K))


@query("delete_counts", f"SELECT CASE WHEN {RECENT} THEN 'recent' ELSE 'historical' END AS tier, count(*) FILTER (NOT {DEAD}) AS active, count(*) FILTER ({DEAD}) AS deleted FROM c GROUP BY 1")
def delete_counts(spark, sf):
    c = corpus(spark, sf)
    return stats.deletion_counts(c, c.where(DEAD).select("id"), AS_OF)


@query("session_stats", f"SELECT count(*) FILTER (NOT {DEAD}) AS active, count(*) FILTER ({DEAD}) AS deleted, count(*) FILTER (NOT {DEAD} AND {RECENT}) AS recent, count(*) FILTER (NOT {DEAD} AND NOT {RECENT}) AS historical, count(*) FILTER ({DEAD} AND {RECENT}) AS recent_deleted, count(*) FILTER ({DEAD} AND NOT {RECENT}) AS historical_deleted, (count(*) FILTER (NOT {DEAD}) * 256)::BIGINT AS vector_bytes FROM c")
def session_stats(spark, sf):
    c = corpus(spark, sf)
    return stats.session_stats(c, c.where(DEAD).select("id"), AS_OF)


@query("batch_delete", "SELECT id, 'deleted' AS status FROM c WHERE id < 10 UNION ALL SELECT -1, 'not found'")
def batch_delete(spark, sf):
    c = corpus(spark, sf)
    dead, unknown = dml.delete_ids(c, c.where("id < 10").select("id").union(spark.createDataFrame([(-1,)], "id long")))
    return dead.withColumn("status", F.lit("deleted")).union(unknown.withColumn("status", F.lit("not found")))


@query("delete_by_filter", "SELECT id FROM c WHERE event_type = 'click' AND k < 50")
def delete_by_filter(spark, sf):
    return dml.delete_where(corpus(spark, sf, metadata=True), {"category": "click", "user.k": {"$lt": 50}})


@query("vacuum", f"SELECT id FROM c WHERE NOT {DEAD}")
def vacuum(spark, sf):
    c = corpus(spark, sf)
    return dml.vacuum(c, c.where(DEAD).select("id")).select("id")


@query("update_metadata", "SELECT id, CASE WHEN id < 20 THEN 'new' ELSE event_type END AS category FROM c")
def update_metadata(spark, sf):
    c = corpus(spark, sf, metadata=True)
    versions = F.explode(F.array(F.struct(F.lit(1).alias("version"), F.lit("old").alias("x")), F.struct(F.lit(2).alias("version"), F.lit("new").alias("x"))))
    updates = c.where("id < 20").select("id", versions.alias("v")).select("id", F.parse_json(F.to_json(F.struct(F.col("v.x").alias("category")))).alias("metadata"), F.col("v.version").alias("version"))
    new, _ = dml.update_metadata(c, updates)
    return new.select("id", F.try_variant_get("metadata", "$.category", "string").alias("category"))


@query("upsert", "SELECT id, CASE WHEN id < 20 THEN 0 ELSE k END AS k FROM c")
def upsert(spark, sf):
    c = corpus(spark, sf, fields=True).select("id", "k")
    return dml.upsert(c, c.where("id < 20").withColumn("k", F.lit(0)))


@query("schema_violations", "SELECT id, 'user.k: expected string, found bigint' AS error FROM c UNION ALL SELECT id, 'absent: required' FROM c")
def schema_violations(spark, sf):
    schema = {"fields": {"category": "String", "views": "Number", "featured": {"type": "boolean"}, "tags": {"Array": "String"}, "user": {"Object": {"id": "Number", "k": "String"}}}, "required": ["category", "absent"]}
    return dml.violations(corpus(spark, sf, metadata=True), schema)


@query("lookup_metadata", SETS + " SELECT s0.id, coalesce(c.event_type, '') AS category FROM s0 LEFT JOIN c ON s0.id = c.id AND c.value > 50")
def lookup_metadata(spark, sf):
    found_, _ = result_sets(spark, sf)
    known = corpus(spark, sf, fields=True).where("value > 50").select("id", F.col("event_type").alias("category"))
    return found_.select("id").join(known, "id", "left").select("id", F.coalesce("category", F.lit("")).alias("category"))


@query("orphan_scan", "SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT vec_id FROM embeddings)", base=False)
def orphan_scan(spark, sf):
    return stats.orphans(table(spark, sf, "events").select(F.col("event_id").alias("id")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


# --- persistence


@query("number_chunks", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS row, (row_number() OVER (ORDER BY id) - 1) // 100 AS chunk FROM c")
def number_chunks(spark, sf):
    return store.number_chunks(corpus(spark, sf), rows=100).select("id", "row", "chunk")


@query("save_load", f"SELECT {FOUND} FROM d WHERE NOT {DEAD} ORDER BY d.distance, id LIMIT {K}")
def save_load(spark, sf):
    c = corpus(spark, sf)
    path = streams.scratch(spark)
    store.save(ivf.assign(c, label_centroids(c)), path, tombstones=c.where(DEAD).select("id"), partition_by=["cluster_id"])
    back = store.load(spark, path, verify=True)
    return out(knn.nearest(dml.active(back["corpus"], back["tombstones"]), q_of(spark, sf), K))


@query("compact", f"SELECT id FROM c WHERE NOT {DEAD}")
def compact(spark, sf):
    c, path = corpus(spark, sf), streams.scratch(spark)
    store.save(c, path, tombstones=c.where(DEAD).select("id"))
    store.compact(spark, path, chunk_rows=200)
    return store.load(spark, path, verify=True)["corpus"].select("id")


@query("chunk_overlap", ", r AS (SELECT id // 100 AS chunk, min(label) AS a, max(label) AS b FROM c GROUP BY 1) SELECT x.chunk, y.chunk AS other FROM r x JOIN r y ON x.chunk < y.chunk WHERE x.a <= y.b AND y.a <= x.b")
def chunk_overlap(spark, sf):
    r = corpus(spark, sf).groupBy(F.floor(F.col("id") / 100).alias("chunk")).agg(F.min("label").alias("a"), F.max("label").alias("b"))
    return store.overlapping(r, "chunk", "a", "b").select("chunk", "other")


@query("backup_increment", f"SELECT id FROM c WHERE ts > TIMESTAMP '{BEFORE}'")
def backup_increment(spark, sf):
    return store.increment(corpus(spark, sf), BEFORE).select("id")


@query("restore", f"SELECT id, CASE WHEN ts > TIMESTAMP '{BEFORE}' THEN 1 ELSE 0 END AS part FROM c")
def restore(spark, sf):
    c = corpus(spark, sf).select("id", "ts")
    full = c.where(F.col("ts") <= F.lit(BEFORE).cast("timestamp")).withColumn("part", F.lit(0))
    return store.restore(full, [store.increment(c, BEFORE).withColumn("part", F.lit(1))]).select("id", "part")


# --- graph


@query("knn_graph", ", x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.embedding, b.embedding) AS distance FROM c a, c b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x) SELECT src, dst, round(distance, 6) + 0.0 AS distance FROM r WHERE n <= 3")
def knn_graph(spark, sf):
    return graph.knn_graph(corpus(spark, sf), 3).select("src", "dst", r6("distance").alias("distance"))


@query("graph_stats", ", x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.embedding, b.embedding) AS distance FROM c a, c b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x), e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM r WHERE n <= 3), g AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id) SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, round(avg(degree), 6) AS avg_degree FROM g")
def graph_stats(spark, sf):
    edges = graph.knn_graph(corpus(spark, sf), 3).select("src", "dst", F.lit(0.0).alias("distance"))
    return graph.graph_stats(edges).select("n_nodes", "n_edges", r6("avg_degree").alias("avg_degree"))


@query("graph_hop", ", x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.embedding, b.embedding) AS distance FROM c a, c b WHERE a.id <> b.id AND a.id < 5), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x) SELECT DISTINCT dst AS id FROM r WHERE n <= 3")
def graph_hop(spark, sf):
    c = corpus(spark, sf)
    seeds = c.where("id < 5")
    return graph.neighbours(graph.knn_graph(c, 3, sources=seeds), seeds.select("id"))


@query("level_distribution", ", l AS (SELECT id, id % 4 AS level FROM c) SELECT i::INT AS layer, count(*) AS n FROM l, range(4) r(i) WHERE i <= level GROUP BY i")
def level_distribution(spark, sf):
    return graph.level_distribution(corpus(spark, sf).select("id", (F.col("id") % 4).cast("int").alias("level")))


# --- streams, drained


def stream_of(spark: SparkSession, c: DataFrame) -> tuple[DataFrame, str]:
    """c as a stream of a few files, and a folder for its results."""
    path = streams.scratch(spark)
    c.repartition(4, "id").write.parquet(f"{path}/in")
    return spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), path


@query("stream_topk", f"SELECT {FOUND} FROM d ORDER BY d.distance, id LIMIT {K}")
def stream_topk(spark, sf):
    c = corpus(spark, sf).select("id", "embedding")
    stream, path = stream_of(spark, c)
    streams.drained(streams.running_top_k(stream, q_of(spark, sf), K, f"{path}/out", f"{path}/state"))
    return out(streams.latest_top_k(spark, f"{path}/out"))


@query("stream_retier", f"SELECT id, CASE WHEN {RECENT} THEN 'recent' ELSE 'historical' END AS tier FROM c")
def stream_retier(spark, sf):
    stream, path = stream_of(spark, corpus(spark, sf).select("id", "ts"))
    streams.drained(streams.retier(stream, AS_OF, f"{path}/out", f"{path}/state"))
    return spark.read.parquet(f"{path}/out").select("id", "tier")


@query("changes", f"SELECT CASE WHEN id % 50 = 0 THEN 'deleted' WHEN id % 50 = 1 THEN 'inserted' WHEN id % 50 = 2 THEN 'updated' ELSE 'migrated' END AS type, id FROM c WHERE id % 50 < 3 OR (ts > TIMESTAMP '{BEFORE}' - INTERVAL 7 DAY AND NOT {RECENT})")
def changes(spark, sf):
    """Two versions of the whole corpus: of 50 rows one is only in the first, one only in the second, and one has another vector there."""
    c = corpus(spark, sf)
    after = c.where("id % 50 <> 0").withColumn("embedding", F.when(F.col("id") % 50 == 2, F.transform("embedding", lambda x: x + 1)).otherwise(F.col("embedding")))
    return streams.changes(c.where("id % 50 <> 1"), after, BEFORE, AS_OF).select("type", "id")


EDITS = "SELECT id, CASE WHEN id % 4 = 0 THEN 'deleted' WHEN id % 4 = 1 THEN 'updated' END AS second FROM c"


@query("stream_changes", f", e AS ({EDITS}) SELECT 'inserted' AS type, id, 1::BIGINT AS version FROM e UNION ALL SELECT second, id, 2::BIGINT FROM e WHERE second IS NOT NULL")
def stream_changes(spark, sf):
    """A stream of edits: first every row, then of four rows a deletion, a new vector, the same vector and an edit that is late."""
    c = corpus(spark, sf).select("id", "embedding", "ts")
    first = c.withColumns({"deleted": F.lit(False), "version": F.lit(1).cast("long")})
    kind = F.col("id") % 4
    second = first.withColumns({"deleted": kind == 0, "version": F.when(kind == 3, 0).otherwise(2).cast("long"), "embedding": F.when((kind == 1) | (kind == 3), F.transform("embedding", lambda x: x + 1)).otherwise(F.col("embedding"))})
    path = streams.scratch(spark)
    for rows in (first, second):
        rows.repartition(2, "id").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
        streams.drained(streams.change_feed(stream, path, f"{path}/checkpoint"))
    return streams.read_feed(spark, path).select("type", "id", "version")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", base=False)
def stream_windows(spark, sf):
    """The same counts from a stream; the last state of each window."""
    stream, path = stream_of(spark, table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp"), "event_type", "value"))
    name = f"windows_{path[-32:]}"
    streams.drained(streams.windowed_counts(stream, late="3650 days").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start())
    return spark.table(name).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", base=False)
def windowed_counts(spark, sf):
    return streams.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


# --- the flagship: nearest rows with their metadata, filtered


@found("filtered_search", f"SELECT {FOUND}, event_type, k FROM d WHERE value > 20 AND k < 90 ORDER BY d.distance, id LIMIT {K}")
def filtered_search(spark, sf):
    c = corpus(spark, sf, fields=True)
    where = compile_filter(json.dumps({"views": {"$gt": 20}, "user.k": {"$lt": 90}}), typed=TYPED)
    return out(knn.nearest(c, q_of(spark, sf), K, where=where), "event_type", "k")




from . import session_queries  # noqa: E402, F401  they register themselves
