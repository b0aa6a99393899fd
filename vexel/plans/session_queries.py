"""Queries that go through a session, the stores, the codecs and the upkeep, each with its SQL; registered with the others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cbor
from ..operators import dml, graph, hybrid, ivf, knn, maintenance, stats
from ..sources import bodies, graphs, store
from ..sources.clusters import ClusterCache
from ..sources.wrappers import BatchingStore, MemoryStore, RetryingStore, open_store
from ..streaming import streams
from .queries import AS_OF, BEFORE, DEAD, IVF, K, N_CLUSTERS, RECENT, clustered, corpus, q_of, query, queries_of, r6, table
from .session import SearchCache, VectorSession

#: Rows of a session: ids are strings.
ROWS = ", v AS (SELECT 'v' || id AS id, embedding, event_type, value, ts, distance FROM d)"
FOUND = "id, round(distance, 6) + 0.0 AS distance, round(1 / (1 + distance), 6) AS score"


def rows(spark, sf) -> DataFrame:
    return corpus(spark, sf, metadata=True).select(F.concat(F.lit("v"), "id").alias("id"), "embedding", "metadata", "ts")


def session(spark, sf) -> VectorSession:
    s = VectorSession(spark, as_of=AS_OF)
    s.add(rows(spark, sf))
    return s


def out(df: DataFrame) -> DataFrame:
    return df.select("id", r6("distance").alias("distance"), r6("score").alias("score"))


@query("session_search", ROWS + f" SELECT {FOUND} FROM v WHERE event_type <> 'view' ORDER BY v.distance, id LIMIT {K}")
def session_search(spark, sf):
    """Add, delete by metadata, and search what is left."""
    s = session(spark, sf)
    s.delete_by_metadata({"category": "view"})
    return out(s.search(q_of(spark, sf), K))


@query("session_filtered", ROWS + f" SELECT {FOUND} FROM v WHERE event_type = 'click' AND value > 20 ORDER BY v.distance, id LIMIT {K}")
def session_filtered(spark, sf):
    return out(session(spark, sf).search(q_of(spark, sf), K, filter={"category": "click", "views": {"$gt": 20}}))


@query("session_batch", f", x AS (SELECT 'q' || query_id AS query_id, 'v' || id AS id, list_distance(embedding, q) AS distance FROM c, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM x) SELECT query_id, rank, {FOUND} FROM r WHERE rank <= {K}")
def session_batch(spark, sf):
    queries = queries_of(corpus(spark, sf)).select(F.concat(F.lit("q"), "query_id").alias("query_id"), "q")
    found = session(spark, sf).search_batch(queries, K)
    return found.select("query_id", "rank", "id", r6("distance").alias("distance"), r6("score").alias("score"))


@query("session_roundtrip", ROWS + f" SELECT {FOUND} FROM v WHERE event_type <> 'view' ORDER BY v.distance, id LIMIT {K}")
def session_roundtrip(spark, sf):
    """Clustered, saved by cluster, loaded with its tombstones, and all clusters probed."""
    s, path = session(spark, sf), streams.scratch(spark)
    s.delete_by_metadata({"category": "view"})
    s.train(N_CLUSTERS, max_iter=3)
    s.save(path)
    return out(VectorSession.load(spark, path, verify=True, as_of=AS_OF).search(q_of(spark, sf), K, n_probe=N_CLUSTERS))


@query("session_clusters", ROWS + f" SELECT {FOUND} FROM v ORDER BY v.distance, id LIMIT {K}")
def session_clusters(spark, sf):
    """Clusters of a saved session, read when they are probed, and again from the cache."""
    s, path = session(spark, sf), streams.scratch(spark)
    s.train(N_CLUSTERS, max_iter=3)
    s.save(path)
    cache = ClusterCache(spark, path)
    cache.search(q_of(spark, sf), K, n_probe=2).count()
    return out(cache.search(q_of(spark, sf), K, n_probe=N_CLUSTERS))


@query("session_add", "SELECT reason, count(*) AS n FROM (SELECT 'duplicate id' AS reason FROM c UNION ALL SELECT 'invalid vector' FROM c) GROUP BY reason")
def session_add(spark, sf):
    """A batch that has every row again, and every row with a vector of another length."""
    s, again = session(spark, sf), rows(spark, sf)
    bad = again.withColumns({"id": F.concat(F.lit("w"), "id"), "embedding": F.slice("embedding", 1, 3)})
    return s.add(again.unionByName(bad))["failures"].groupBy("reason").agg(F.count("*").alias("n"))


@query("session_deleted", "SELECT 'v' || id AS id FROM c WHERE event_type = 'click'")
def session_deleted(spark, sf):
    s = session(spark, sf)
    s.delete_by_metadata({"category": "click"})
    return s.deleted()


@query("session_vacuum", "SELECT count(*) FILTER (event_type <> 'click') AS rows, count(*) FILTER (event_type = 'click') AS again FROM c")
def session_vacuum(spark, sf):
    """Vacuumed ids may be inserted again."""
    s = session(spark, sf)
    s.delete_by_metadata({"category": "click"})
    s.vacuum()
    left = s.corpus.count()
    added = s.add(rows(spark, sf))["added"]
    return spark.createDataFrame([(left, added)], "rows long, again long")


@query("session_get", "SELECT 'v' || id AS id, event_type AS category, round(list_sum(embedding), 4) + 0.0 AS total FROM c WHERE id = 7")
def session_get(spark, sf):
    r = session(spark, sf).get("v7")
    return spark.createDataFrame([(r.id, r.metadata.toPython()["category"], round(sum(r.embedding), 4) + 0.0)], "id string, category string, total double")


@query("session_delete", "SELECT 'v' || id AS id FROM c WHERE id <> 7")
def session_delete(spark, sf):
    s = session(spark, sf)
    s.delete("v7")
    return s.active.select("id")


@query("session_update", "SELECT 'v' || id AS id, CASE WHEN id = 7 THEN 'new' ELSE event_type END AS category FROM c")
def session_update(spark, sf):
    s = session(spark, sf)
    s.update_metadata("v7", {"category": "new"})
    return s.active.select("id", F.try_variant_get("metadata", "$.category", "string").alias("category"))


@query("session_lifecycle", "SELECT count(*) AS active, 0::BIGINT AS deleted, true AS destroyed FROM c")
def session_lifecycle(spark, sf):
    with session(spark, sf) as s:
        found = s.stats()
    try:
        s.stats()
    except RuntimeError:
        return spark.createDataFrame([(found["active"], found["deleted"], True)], "active long, deleted long, destroyed boolean")


@query("session_cache", "SELECT 2::BIGINT AS hits, 2::BIGINT AS misses, round(0.5, 6)::DOUBLE AS hit_rate")
def session_cache(spark, sf):
    """The same search three times, and once more after a deletion."""
    s, cache, q = session(spark, sf), SearchCache(), q_of(spark, sf)
    for _ in range(3):
        cache.search(s, q, K)
    s.delete("v7")
    cache.search(s, q, K)
    c = cache.stats()
    return spark.createDataFrame([(c["hits"], c["misses"], c["hit_rate"])], "hits long, misses long, hit_rate double")


@query("search_vectors", ROWS + f", t AS (SELECT * FROM v ORDER BY distance, id LIMIT {K}) SELECT t.id, i::INT AS i, round(embedding[i + 1], 6) + 0.0 AS v FROM t, range(64) r(i)")
def search_vectors(spark, sf):
    """Results with the vectors that were found."""
    found = session(spark, sf).search(q_of(spark, sf), K, include_vectors=True)
    return found.select("id", F.posexplode("embedding").alias("i", "v")).select("id", "i", r6(F.col("v").cast("double")).alias("v"))


@query("query_expansion", "SELECT i AS n, round(sqrt(list_inner_product(q, q)), 6) AS norm FROM q0, range(4) r(i)")
def query_expansion(spark, sf):
    """Noisy copies of a query keep its length."""
    copies = knn.expand_query(q_of(spark, sf), 4)
    return spark.createDataFrame([(i, round(math.sqrt(sum(x * x for x in v)), 6)) for i, v in enumerate(copies)], "n long, norm double")


@query("suggest_config", f"SELECT k::INT AS k, (CASE WHEN k < 10 THEN 5 WHEN k < 50 THEN 10 ELSE 20 END)::INT AS n_probe, (CASE WHEN k < 10 THEN 50 WHEN k < 50 THEN 100 ELSE 200 END)::INT AS ef, (SELECT count(*) FILTER ({RECENT}) > 0 FROM c) AS search_recent FROM (VALUES (1), (10), (50)) t(k)")
def suggest_config(spark, sf):
    n = stats.tier_counts(corpus(spark, sf), AS_OF).first()
    got = [(k, hybrid.suggest_search(k, n.recent, n.historical)) for k in (1, 10, 50)]
    return spark.createDataFrame([(k, p["n_probe"], p["ef"], p["search_recent"]) for k, p in got], "k int, n_probe int, ef int, search_recent boolean")


@query("request_insert", "SELECT CASE id % 10 WHEN 3 THEN 'malformed' WHEN 4 THEN 'too large' WHEN 5 THEN 'no id' WHEN 6 THEN 'invalid vector' ELSE 'added' END AS outcome, count(*) AS n FROM c GROUP BY 1")
def request_insert(spark, sf):
    """Request bodies, a line each, some of them broken, too large, without an id or with a vector of another length."""
    kind, path = F.col("id") % 10, streams.scratch(spark)
    vector = F.when(kind == 6, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    doc = F.struct(F.when(kind != 5, F.concat(F.lit("v"), "id")).alias("id"), vector.alias("vector"), F.struct(F.when(kind == 4, F.repeat(F.lit("x"), 20_000)).alias("note"), kind.alias("kind")).alias("metadata"))
    body = F.to_json(doc)
    c = corpus(spark, sf, fields=True)
    c.select(F.when(kind == 3, F.substring(body, 1, 40)).otherwise(body).alias("value")).write.text(path)
    found, refused = bodies.parse(bodies.read_lines(spark, path), most_bytes=16_384)
    s = VectorSession(spark, as_of=AS_OF)
    done = s.add(found.withColumn("ts", F.lit(AS_OF).cast("timestamp")).where("size(embedding) = 64"))["added"]
    short = s.add(found.withColumn("ts", F.lit(AS_OF).cast("timestamp")).where("size(embedding) <> 64"))["failures"]
    said = refused.select(F.col("reason").alias("outcome")).unionByName(short.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))
    return said.union(spark.createDataFrame([("added", done)], "outcome string, n long"))


# --- training


@query("pq_trained", "SELECT count(*) AS n, 4::BIGINT AS subspaces, true AS nearer FROM c")
def pq_trained(spark, sf):
    """A codebook fitted on all rows, and all rows encoded by it; its error is below that of the first rows as a codebook."""
    from ..functions import vectors
    from .queries import codebook

    c = corpus(spark, sf)
    books = [ivf.pq_train(c, 4, 8, iterations=3), codebook(c)]

    def error(book):
        coded = ivf.pq_encode(c, book)
        return coded.agg(F.avg(vectors.euclidean(vectors.pq_decode("codes", book), "embedding"))).first()[0]

    coded = ivf.pq_encode(c, books[0]).agg(F.count("*").alias("n"), F.max(F.size("codes")).cast("long").alias("subspaces"))
    return coded.withColumn("nearer", F.lit(error(books[0]) <= error(books[1])))


@query("ivf_retrain", f"SELECT count(*) AS n, {N_CLUSTERS + 2}::BIGINT AS clusters, true AS better FROM c")
def ivf_retrain(spark, sf):
    """Two more clusters, trained anew on all rows; the error falls with training."""
    c, centroids, _ = clustered(spark, sf)
    new, assigned = ivf.add_clusters(c, centroids, 2, max_iter=5)
    sizes = ivf.cluster_sizes(assigned, new).agg(F.sum("n").alias("n"), F.count("*").alias("clusters"))
    return sizes.withColumn("better", F.lit(new.final_error <= new.initial_error))


@query("ivf_optimize", f"SELECT count(*) AS n, {N_CLUSTERS}::BIGINT AS clusters, true AS sound FROM c")
def ivf_optimize(spark, sf):
    c, centroids, _ = clustered(spark, sf)
    new, assigned, gain = ivf.optimize(c, centroids, max_iter=3)
    return ivf.cluster_sizes(assigned, new).agg(F.sum("n").alias("n"), F.count("*").alias("clusters")).withColumn("sound", F.lit(gain >= 0))


@query("centroid_roundtrip", IVF + "SELECT cluster_id, i::INT AS i, round(vector[i + 1], 6) + 0.0 AS v FROM m, range(64) r(i)")
def centroid_roundtrip(spark, sf):
    """Centroids as bytes in a store, read again."""
    blobs = store.BlobStore(spark, streams.scratch(spark))
    blobs.put("centroids", clustered(spark, sf)[1].to_bytes())
    back = ivf.Centroids.from_bytes(blobs.get("centroids"))
    return back.table(spark).select("cluster_id", F.posexplode("vector").alias("i", "v")).select("cluster_id", "i", r6("v").alias("v"))


@query("initialise_tiers", f"SELECT count(*) FILTER ({RECENT}) AS recent, count(*) FILTER (NOT {RECENT}) AS historical, least({N_CLUSTERS}, count(*)) AS clusters FROM c")
def initialise_tiers(spark, sf):
    """A session trained on its rows: both tiers are there to be searched."""
    s = session(spark, sf)
    c = s.train(N_CLUSTERS, max_iter=2)
    return stats.tier_counts(s.corpus, AS_OF).select("recent", "historical", F.lit(len(c.ids)).cast("long").alias("clusters"))


# --- stores and codecs


def nations(spark, sf) -> list:
    return table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()


def blob_query(name, make):
    @query(name, "SELECT n_name AS name, n_nationkey AS key FROM nation WHERE n_nationkey % 5 <> 0", base=False)
    def run(spark, sf):
        """Blobs written, some deleted, listed, and read again."""
        s = make(spark)
        for r in nations(spark, sf):
            s.put(f"n/{r.n_nationkey:05d}", r.n_name.encode())
        for key in s.list("n/"):
            if int(key[2:]) % 5 == 0:
                s.delete(key)
        return spark.createDataFrame([(s.get(k).decode(), int(k[2:])) for k in s.list("n/")], "name string, key int")


blob_query("store_blobs", lambda spark: store.BlobStore(spark, streams.scratch(spark)))
blob_query("store_memory", lambda spark: MemoryStore())
blob_query("store_retrying", lambda spark: RetryingStore(MemoryStore()))
blob_query("store_batching", lambda spark: BatchingStore(MemoryStore(), most=7))
blob_query("store_configured", lambda spark: open_store(spark, {"path": streams.scratch(spark), "retries": "2", "cache": "10", "ttl": "60"}))


@query("store_cached", "SELECT count(*) * 2 AS hits, count(*) AS misses, count(*) AS entries, sum(length(n_name))::BIGINT AS bytes FROM nation", base=False)
def store_cached(spark, sf):
    """Every blob read three times through a cache."""
    inner = MemoryStore()
    for r in nations(spark, sf):
        inner.put(str(r.n_nationkey), r.n_name.encode())
    cached = store.CachedStore(inner, capacity=1000)
    for _ in range(3):
        for key in inner.list():
            cached.get(key)
    s = cached.stats()
    return spark.createDataFrame([(s["hits"], s["misses"], s["entries"], s["bytes"])], "hits long, misses long, entries long, bytes long")


@query("store_content", "SELECT n_name AS name, sha256(n_name) AS cid FROM nation", base=False)
def store_content(spark, sf):
    """Blobs by what they hold, compressed, read again by their hash."""
    s = store.ContentStore(MemoryStore())
    cids = s.put_batch({r.n_name: r.n_name.encode() for r in nations(spark, sf)}, compress=True)
    return spark.createDataFrame([(s.get_by_cid(c).decode(), c) for c in cids.values()], "name string, cid string")


@query("stored_bytes", "SELECT count(*) AS n, sum(length(n_name))::BIGINT AS bytes FROM nation", base=False)
def stored_bytes(spark, sf):
    blobs = store.BlobStore(spark, streams.scratch(spark))
    for r in nations(spark, sf):
        blobs.put(f"b/{r.n_nationkey}", r.n_name.encode())
    return stats.stored_bytes(blobs.table())


@query("typed_values", "SELECT n_nationkey AS key, n_name AS name FROM nation", base=False)
def typed_values(spark, sf):
    """Values of any kind by key, as CBOR in a store."""
    blobs = MemoryStore()
    for r in nations(spark, sf):
        blobs.put(str(r.n_nationkey), cbor.encode({"key": r.n_nationkey, "name": r.n_name, "none": None}))
    found = [cbor.decode(blobs.get(k)) for k in blobs.list()]
    return spark.createDataFrame([(f["key"], f["name"]) for f in found], "key int, name string")


@query("cbor_roundtrip", "SELECT id, i::INT AS i, round(embedding[i + 1], 6) + 0.0 AS v, event_type, user_id FROM c, range(64) r(i)")
def cbor_roundtrip(spark, sf):
    """Every row as CBOR bytes, and back."""
    c = corpus(spark, sf, fields=True).select("id", "embedding", "event_type", "user_id")
    back = cbor.decode_rows(cbor.encode_rows(c), c.schema)
    return back.select("id", F.posexplode("embedding").alias("i", "v"), "event_type", "user_id").withColumn("v", r6("v"))


@query("cbor_bytes", "SELECT vec_id AS id, (1 + 3 + CASE WHEN vec_id < 24 THEN 1 WHEN vec_id < 256 THEN 2 WHEN vec_id < 65536 THEN 3 WHEN vec_id < 4294967296 THEN 5 ELSE 9 END + 10 + 2 + 64 * 5)::BIGINT AS n FROM embeddings", base=False)
def cbor_bytes(spark, sf):
    """The size of each row's encoding: a map of id and embedding, 32 bits an element."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    data = cbor.encode_rows(e)
    return data.select(cbor_id(data).alias("id"), F.length("data").cast("long").alias("n"))


def cbor_id(data: DataFrame):
    """The id that an encoding begins with, from its bytes."""
    b = F.hex(F.substring("data", 5, 9))
    low = F.conv(F.substring(b, 1, 2), 16, 10).cast("int")
    width = F.when(low < 24, 0).when(low == 24, 2).when(low == 25, 4).when(low == 26, 8).otherwise(16)
    return F.when(low < 24, low.cast("long")).otherwise(F.conv(F.substr(b, F.lit(3), width), 16, 10).cast("long"))


# --- persistence and upkeep


def saved(spark, sf, **options) -> str:
    c, path = corpus(spark, sf), streams.scratch(spark)
    store.save(c, path, tombstones=c.where(DEAD).select("id"), **options)
    return path


@query("manifest_info", "SELECT count(*) AS rows, 3::BIGINT AS version, true AS tombstones, false AS centroids FROM c")
def manifest_info(spark, sf):
    m = store.info(spark, saved(spark, sf))
    return spark.createDataFrame([(m["rows"], m["version"], m["tombstones"], m["centroids"])], "rows long, version long, tombstones boolean, centroids boolean")


@query("backup_verify", "SELECT true AS whole, false AS cut")
def backup_verify(spark, sf):
    """A saved corpus, and the same without one of its files."""
    path = saved(spark, sf, chunk_rows=100)
    whole = store.verify(spark, path)["valid"]
    store.BlobStore(spark, path).delete(store.read_manifest(spark, path)["chunks"][0]["chunk_id"])
    return spark.createDataFrame([(whole, store.verify(spark, path)["valid"])], "whole boolean, cut boolean")


@query("single_file", f"SELECT id FROM c WHERE NOT {DEAD}")
def single_file(spark, sf):
    found = store.load(spark, saved(spark, sf, single=True), verify=True)
    if len(found["manifest"]["chunks"]) != 1:
        raise store.StoreError("more than one file")
    return found["corpus"].join(found["tombstones"], "id", "left_anti").select("id")


@query("cleanup", "SELECT 1::BIGINT AS swept, count(*) AS rows FROM c")
def cleanup(spark, sf):
    """An older version of a corpus goes, the present one stays."""
    c, path = corpus(spark, sf), streams.scratch(spark)
    store.save(c.where("id % 2 = 0"), path)
    store.save(c, path)
    there = maintenance.orphaned_files(spark, path).count() > 0
    swept = len(store.sweep(spark, path)) if there else 0
    return spark.createDataFrame([(swept, store.load(spark, path)["corpus"].count())], "swept long, rows long")


@query("migrate_ids", f"SELECT id, CASE WHEN {RECENT} THEN 'migrated' ELSE 'already historical' END AS status FROM c UNION ALL SELECT -1, 'not found'")
def migrate_ids(spark, sf):
    c = corpus(spark, sf)
    return maintenance.migrate_ids(c, c.select("id").union(spark.createDataFrame([(-1,)], "id long")), AS_OF)


@query("aged_out", f"SELECT count(*) FILTER ({RECENT} AND id % 2 = 0) AS recent, count(*) FILTER (NOT ({RECENT} AND id % 2 = 0)) AS historical FROM c")
def aged_out(spark, sf):
    """Every other row is moved to the historical tier."""
    c = corpus(spark, sf)
    return stats.tier_counts(maintenance.age_out(c, c.where("id % 2 = 1").select("id"), AS_OF), AS_OF).select("recent", "historical")


@query("backup_retention", "SELECT 'b' || id AS path, row_number() OVER (ORDER BY ts DESC, 'b' || id) <= 7 AS kept FROM c")
def backup_retention(spark, sf):
    return maintenance.retained(corpus(spark, sf).select(F.concat(F.lit("b"), "id").alias("path"), "ts"), 7).select("path", "kept")


@query("alerts", f"SELECT CASE WHEN count(*) FILTER ({RECENT}) > 0 THEN 2 ELSE 0 END::BIGINT AS called FROM c")
def alerts(spark, sf):
    """A handler hears of a warning, and of its end."""
    a, heard = maintenance.Alerts(), []
    a.on(heard.append)
    for most in (0, 1 << 40):
        a.see(stats.health(corpus(spark, sf), AS_OF, most_recent=most).first().asDict())
    return spark.createDataFrame([(len(heard),)], "called long")


@query("scheduled", "SELECT 2::BIGINT AS runs, 1::BIGINT AS failures, count(*) AS migrated FROM (SELECT id FROM c WHERE ts > TIMESTAMP '" + BEFORE + f"' - INTERVAL 7 DAY AND NOT {RECENT})")
def scheduled(spark, sf):
    """A step of upkeep that works, and then one that fails."""
    steps = [lambda: hybrid.migration(corpus(spark, sf), BEFORE, AS_OF).count(), lambda: 1 / 0]
    loop = maintenance.Loop(lambda: steps[loop.runs - 1](), 3600)
    loop.run_once()
    done = loop.last
    loop.run_once()
    return spark.createDataFrame([(loop.runs, loop.failures, done)], "runs long, failures long, migrated long")


@query("auto_migration", "SELECT 1::BIGINT AS runs, count(*) AS migrated FROM (SELECT id FROM c WHERE ts > TIMESTAMP '" + BEFORE + f"' - INTERVAL 7 DAY AND NOT {RECENT})")
def auto_migration(spark, sf):
    """Switched on, aged rows are migrated at once; switched off, no more."""
    loop = maintenance.Loop(lambda: hybrid.migration(corpus(spark, sf), BEFORE, AS_OF).count(), 3600).start(now=True)
    loop.stop()
    return spark.createDataFrame([(loop.runs, loop.last)], "runs long, migrated long")


@query("insert_chunk", "SELECT id, 'second' AS chunk, 'added' AS outcome FROM c WHERE id % 2 = 1 UNION ALL SELECT id, 'first', 'duplicate id' FROM c WHERE id % 2 = 0")
def insert_chunk(spark, sf):
    """All rows inserted into a chunk, half of them there already in another; the table is read again by chunk."""
    c, path = corpus(spark, sf), streams.scratch(spark)
    c.where("id % 2 = 0").withColumn("chunk", F.lit("first")).write.partitionBy("chunk").parquet(path)
    added, refused = dml.insert_into_chunk(spark.read.parquet(path), c, "second")
    refused = refused.select("id", "reason").join(spark.read.parquet(path).select("id", "chunk"), "id").select("id", "chunk", F.col("reason").alias("outcome"))
    refused.write.parquet(f"{path}-refused")
    added.write.partitionBy("chunk").mode("append").parquet(path)
    new = spark.read.parquet(path).where("chunk = 'second'").select("id", "chunk", F.lit("added").alias("outcome"))
    return new.unionByName(spark.read.parquet(f"{path}-refused"))


# --- the navigable graph


@query("graph_insert", ", x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.embedding, b.embedding) AS distance FROM c a, c b WHERE a.id <> b.id), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x WHERE src % 5 <> 0 AND dst % 5 <> 0) WHERE n <= 3), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x WHERE src % 5 = 0) WHERE n <= 3), u AS (SELECT src, dst, distance FROM o UNION SELECT src, dst, distance FROM w UNION SELECT dst, src, distance FROM w), g AS (SELECT src, dst, min(distance) AS distance FROM u GROUP BY src, dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM g) SELECT src, dst FROM r WHERE n <= 3")
def graph_insert(spark, sf):
    """A graph of four fifths of the rows, and the others inserted."""
    c = corpus(spark, sf)
    old, new = c.where("id % 5 <> 0"), c.where("id % 5 = 0")
    return graph.insert(graph.knn_graph(old, 3), old, new, 3).select("src", "dst")


@query("graph_search", "SELECT count(*)::BIGINT AS queries, true AS near FROM q")
def graph_search(spark, sf):
    """Searches by the layers of a graph over all rows, written by id: mean recall of 0.9 or more."""
    c, path = corpus(spark, sf).select("id", "embedding"), streams.scratch(spark)
    graph.build(c, m=8).repartitionByRange(8, "src").sortWithinPartitions("layer", "src").write.parquet(f"{path}/edges")
    edges, qs = spark.read.parquet(f"{path}/edges"), queries_of(c).collect()
    found = graph.search_batch(edges, c, {r.query_id: list(r.q) for r in qs}, K, ef=64)
    truth = knn.nearest_batch(c, queries_of(c), K)
    good = knn.recall(found, truth, K).first().recall >= 0.9
    return spark.createDataFrame([(len(qs), good)], "queries long, near boolean")


@query("graph_delete", ", x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.embedding, b.embedding) AS distance FROM c a, c b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x) SELECT src, dst FROM r WHERE n <= 3 AND src % 7 <> 0 AND dst % 7 <> 0")
def graph_delete(spark, sf):
    """Edges saved, loaded, and without those of deleted rows."""
    c, path = corpus(spark, sf), streams.scratch(spark)
    graph.knn_graph(c, 3).write.parquet(f"{path}/edges")
    return graph.remove(spark.read.parquet(f"{path}/edges"), c.where(DEAD).select("id")).select("src", "dst")


@query("graph_saved", ", x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.embedding, b.embedding) AS distance FROM c a, c b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS n FROM x) SELECT 0 AS layer, src, dst FROM r WHERE n <= CASE src % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 3 END")
def graph_saved(spark, sf):
    """A graph saved, changed at some nodes (cut, or left without edges), merged, copied, and loaded from the copy."""
    c, path = corpus(spark, sf), streams.scratch(spark)
    edges = graph.knn_graph(c, 3)
    graphs.save(edges, path)
    graphs.save_changes(graph.prune(graphs.load(spark, path).where("src % 5 = 0"), 2), c.where("id % 5 = 0"), path)
    graphs.save_changes(edges.limit(0), c.where("id % 5 = 1"), path)
    graphs.copy(spark, path, f"{path}-copy")
    graphs.merge(spark, f"{path}-copy")
    return graphs.load(spark, f"{path}-copy", verify=True).select("layer", "src", "dst")


@query("graph_verify", "SELECT true AS whole, false AS cut, true AS refused")
def graph_verify(spark, sf):
    """A saved graph, the same without one of its files, and one of a version that isn't known."""
    c, path = corpus(spark, sf), streams.scratch(spark)
    m = graphs.save(graph.knn_graph(c, 3), path)
    whole, blobs = graphs.verify(spark, path)["valid"], store.BlobStore(spark, path)
    blobs.delete(next(k for k in blobs.list(m["base"]["data"]) if k.endswith(".parquet")))
    cut = graphs.verify(spark, path)["valid"]
    blobs.put(graphs.MANIFEST, b'{"version": 2}')
    try:
        refused = graphs.load(spark, path) is None
    except store.StoreError:
        refused = True
    return spark.createDataFrame([(whole, cut, refused)], "whole boolean, cut boolean, refused boolean")
