"""Search, clusters, tiers, changes, stores and sessions, on small corpora."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import kernels
from vexel.functions.filters import compile_filter
from vexel.operators import dml, graph, hybrid, ivf, knn, maintenance, rank, stats
from vexel.plans.session import SearchCache, SessionError, VectorSession
from vexel.sources import bodies, graphs, store
from vexel.sources.clusters import ClusterCache
from vexel.streaming import streams

NOW = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def blobs(spark):
    centers = [(0, 0), (5, 5), (-5, -5)]
    rows = [(3 * i + j, [x + 0.1 * j, y - 0.1 * j], NOW if j else "2024-01-01 00:00:00") for i, (x, y) in enumerate(centers) for j in range(3)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, ts string").withColumn("ts", F.col("ts").cast("timestamp")).cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_nearest(blobs):
    assert ids(knn.nearest(blobs, [5.0, 5.0], 3)) == [3, 4, 5]
    assert len(ids(knn.nearest(blobs, [0.0, 0.0], 100))) == 9 and ids(knn.nearest(blobs, [0.0, 0.0], 0)) == []
    first = knn.nearest(blobs, [5.0, 5.0], 1).first()
    assert first.distance == 0 and first.score == 1
    assert ids(knn.nearest(blobs.limit(0), [0.0, 0.0], 3)) == []


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "id long, embedding array<double>")
    assert ids(knn.nearest(df, [0.0, 0.0], 2)) == [1, 3]
    got = knn.nearest_batch(df, df.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 2)
    assert sorted((r.query_id, r.rank, r.id) for r in got.collect())[:2] == [(1, 1, 1), (1, 2, 3)]


def test_blocks_give_the_same_as_a_batch(blobs, monkeypatch):
    queries = blobs.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    few = sorted(map(tuple, knn.nearest_batch(blobs, queries, 4).collect()))
    monkeypatch.setattr(knn, "collect_queries", lambda q: None)
    monkeypatch.setattr(knn, "BATCH_QUERIES", 4)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, knn.nearest_batch(blobs, queries, 4).collect())) == few


def test_recommend_and_similar(blobs):
    assert 3 not in ids(knn.recommend(blobs, [3, 3], 9)) and ids(knn.recommend(blobs, [], 3)) == []
    assert ids(knn.find_similar(blobs, 4, 1)) == [4]
    with pytest.raises(KeyError):
        knn.find_similar(blobs, 99, 1)


def test_query_expansion():
    out = knn.expand_query([3.0, 4.0], 5)
    assert len(out) == 5 and out[0] == [3.0, 4.0] and all(abs(np.linalg.norm(x) - 5) < 1e-9 for x in out)


def test_training(blobs):
    c = ivf.train(blobs, 3, seed=1)
    a = ivf.assign(blobs, c)
    assert c.final_error <= c.initial_error and len({(r.id // 3, r.cluster_id) for r in a.collect()}) <= 5
    assert ivf.cluster_stats(a, c).first().total == 9
    q = blobs.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    exact = knn.nearest_batch(blobs, q, 3)
    recalls = [knn.recall(ivf.search_batch(a, c, q, 3, n), exact, 3).first().recall for n in (1, 2, 3)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    assert ids(ivf.search(a, c, [5.0, 5.0], 3, n_probe=3)) == [3, 4, 5]


@pytest.mark.parametrize(("rows", "k"), [([], 2), ([(0, [1.0])], 2), ([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], 2)])
def test_training_errors(spark, rows, k):
    with pytest.raises(ivf.TrainingError):
        ivf.train(spark.createDataFrame(rows, "id long, embedding array<double>"), k)


def test_seeds_balance_and_tables(blobs):
    c = ivf.evenly_seeded(blobs, 3)
    assert c.vectors.tolist() == [[0.0, 0.0], [5.0, 5.0], [-5.0, -5.0]]
    skewed = ivf.Centroids(np.array([[0.0, 0.0], [100.0, 100.0]]))
    moved = ivf.balance(ivf.assign(blobs, skewed), skewed, 0.5)
    assert moved.count() == 9 and moved.where("moved").count() > 0
    assert ivf.Centroids.from_table(c.table(blobs.sparkSession)).vectors.tolist() == c.vectors.tolist()
    with pytest.raises(ValueError):
        ivf.balance(blobs, c, 1.5)


def test_codebooks(blobs):
    from vexel.functions import vectors as V

    book = ivf.pq_train(blobs, 2, 3)
    assert [len(b) for b in book] == [3, 3] and ivf.pq_train(blobs.limit(0), 2, 3) == []
    errors = blobs.select(V.euclidean(V.pq_decode(V.pq_encode("embedding", book, 2), book), "embedding").alias("e")).collect()
    assert max(r.e for r in errors) < 1
    c, a = ivf.cluster_evenly(blobs.where("id <> 0 and id <> 1 and id <> 2"), 2)
    assert c.converged and ivf.cluster_sizes(a, c).agg(F.sum("n")).first()[0] == 6


def test_tiers(blobs):
    assert tuple(stats.tier_counts(blobs, NOW).first()) == (6, 3, 9)
    assert ids(hybrid.search(blobs, [5.0, 5.0], 3, NOW)) == [3, 4, 5]
    assert ids(hybrid.search(blobs, [5.0, 5.0], 3, NOW, recent_k=0)) == [3, 0, 6]
    assert sorted(ids(hybrid.migration(blobs, "2024-01-05 00:00:00", NOW))) == [0, 3, 6]
    assert stats.age_distribution(blobs.limit(0), NOW).first().total == 0


def test_plans():
    assert hybrid.plan_search(0, 20_000) == {"search_recent": False, "search_historical": True, "n_probe": 20, "ef": 200}
    assert hybrid.suggest_search(5, 1, 1)["n_probe"] == 5


def test_merging(spark):
    a = spark.createDataFrame([(1, 0.1, 0.9), (2, 0.5, 0.5)], "id long, distance double, score double")
    b = spark.createDataFrame([(1, 0.3, 0.7), (3, 0.2, 0.8)], "id long, distance double, score double")
    get = lambda **o: {r.id: (round(r.score, 6), round(r.distance, 6)) for r in rank.merge([a, b], 10, **o).collect()}
    assert get(strategy="best")[1] == (0.9, 0.1)
    assert get(strategy="average")[1] == (0.8, 0.2)
    assert get(strategy="weighted", weights=[2.0])[1] == (round((0.9 * 2 + 0.7) / 3, 6), round((0.1 * 2 + 0.3) / 3, 6))
    assert ids(rank.merge_search_results([a, b], 2)) == [1, 3]
    with pytest.raises(ValueError):
        rank.merge([a], 1, strategy="odd")


def test_scores(spark):
    df = spark.createDataFrame([(1, 0.5, '{"boost": "1.5", "timestamp": "2024-01-24T00:00:00Z", "views": 0}'), (2, 0.5, '{"boost": "x", "timestamp": "odd"}')], "id long, distance double, m string").withColumn("metadata", F.parse_json("m"))
    r = df.select(rank.boosted().alias("b"), rank.time_decayed(NOW, 7 * 86_400).alias("t"), rank.combined([]).alias("c")).collect()
    assert [x.b for x in r] == [0.75, 0.5] and [x.t for x in r] == [0.25, 0.5] and r[0].c == 0.5


def test_latency_order_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "ms double")
    assert tuple(stats.latency_stats(df).first()) == (10, 5.5, 6.0, 10.0)


def test_insert_reports_bad_rows(spark):
    old = spark.createDataFrame([(1, [1.0, 1.0])], "id long, embedding array<double>")
    new = spark.createDataFrame([(1, [2.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [3.0, 3.0]), (5, [float("nan"), 0.0]), (6, None), (4, [3.0, 3.0])], "id long, embedding array<double>")
    good, bad = dml.split_insert(old, new, 2)
    assert sorted(ids(good)) == [2, 4]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(1, "duplicate id"), (3, "invalid vector"), (4, "duplicate id"), (5, "invalid vector"), (6, "invalid vector")]


SCHEMA = {"fields": {"title": "String", "views": "Number", "published": "Boolean", "tags": {"Array": "String"}, "author": {"Object": {"name": "String", "verified": "Boolean"}}}, "required": ["title", "views"]}


@pytest.mark.parametrize(
    ("doc", "errors"),
    [
        ('{"title": "a", "views": 1}', []), ('{"title": null, "views": 1.5, "extra": [1]}', []), ('{"views": 1}', ["title: required"]), ('{"title": 1, "views": 1}', ["title: expected string, found bigint"]),
        ('{"title": "a", "views": 1, "tags": ["x", 2]}', ["tags[1]: expected string, found bigint"]), ('{"title": "a", "views": 1, "tags": "x"}', ["tags: expected array, found string"]),
        ('{"title": "a", "views": 1, "author": {"name": "n", "verified": "yes"}}', ["author.verified: expected boolean, found string"]), ("[1]", ["metadata: expected object"]),
    ],
)
def test_schema(spark, doc, errors):
    df = spark.createDataFrame([(1, doc)], "id long, m string").select("id", F.parse_json("m").alias("metadata"))
    assert [r.error for r in dml.violations(df, SCHEMA).collect()] == errors


def test_bad_schema():
    with pytest.raises(ValueError):
        dml.parse_schema({"fields": {"a": "Odd"}})


def test_graph(blobs):
    edges = graph.knn_graph(blobs, 2)
    assert edges.count() == 18 and edges.where("src = dst").count() == 0
    assert graph.prune(edges, 1).count() == 9
    assert graph.graph_stats(edges).first().n_nodes == 9


def test_store(spark, blobs, tmp_path):
    path = str(tmp_path / "s")
    store.save(blobs, path, tombstones=blobs.where("id = 1").select("id"), chunk_rows=4)
    first = store.load(spark, path, verify=True)
    assert first["corpus"].count() == 9 and ids(first["tombstones"]) == [1] and first["centroids"] is None
    store.save(blobs.limit(2), path)
    assert store.load(spark, path)["corpus"].count() == 2
    assert len(store.sweep(spark, path)) == 1 and store.load(spark, path, verify=True)["corpus"].count() == 2
    with pytest.raises(store.StoreError):
        store.load(spark, str(tmp_path / "none"))
    store.save(blobs.limit(0), path)
    assert store.load(spark, path, verify=True)["corpus"].count() == 0


@pytest.mark.parametrize("text", ["{", "[]", "{}", '{"version": 100, "chunk_size": 1, "total_vectors": 0, "chunks": []}', '{"version": 3, "chunk_size": 1, "total_vectors": 0, "chunks": [{"chunk_id": "a"}, {"chunk_id": "a"}]}'])
def test_manifest_errors(text):
    with pytest.raises(store.StoreError):
        store.validate_manifest(text)


@pytest.mark.parametrize(("n", "chunks"), [(0, 0), (5, 1), (10, 1), (11, 2), (25, 3)])
def test_chunks(spark, n, chunks):
    df = store.number_chunks(spark.range(n), rows=10, buckets=4)
    assert sorted(r.row for r in df.collect()) == list(range(n)) and df.select("chunk").distinct().count() == chunks


def test_blobs(spark, tmp_path):
    s = store.BlobStore(spark, str(tmp_path / "b"))
    s.put("a/x", b"one")
    s.put("a/x", b"two")
    s.put("b", b"three")
    assert s.get("a/x") == b"two" and s.get("c") is None and s.list("a/") == ["a/x"] and s.table().count() == 2
    time = [0.0]
    cached = store.CachedStore(s, capacity=1, ttl=10, clock=lambda: time[0])
    assert cached.get("b") == cached.get("b") == b"three"
    time[0] = 11
    cached.get("b")
    cached.get("a/x")
    assert cached.stats() == {"hits": 1, "misses": 3, "entries": 1, "bytes": 3, "hit_rate": 0.25}
    content = store.ContentStore(s)
    assert content.put("k", b"v") == content.put("l", b"v") and content.get("l") == b"v" and content.get("m") is None
    assert s.delete("b") and not s.exists("b")


def test_session(spark, tmp_path):
    with VectorSession(spark, as_of=NOW) as s:
        got = s.add([{"id": f"v{i}", "vector": [float(i), 0.0], "metadata": {"n": i, "kind": "even" if i % 2 == 0 else "odd"}} for i in range(12)] + [{"id": "v0", "vector": [1.0, 1.0]}, {"id": "bad", "vector": [1.0]}])
        assert got["added"] == 12 and sorted(got["failed"]) == [("bad", "invalid vector"), ("v0", "duplicate id")]
        assert ids(s.search([3.0, 0.0], 3)) == ["v3", "v2", "v4"]
        assert ids(s.search([3.0, 0.0], 2, filter={"kind": "even"})) == ["v2", "v4"]
        assert ids(s.search([3.0, 0.0], 2, threshold=0.9)) == ["v3"]
        with pytest.raises(SessionError):
            s.search([1.0], 1)
        cache = SearchCache(capacity=1)
        assert cache.search(s, [3.0, 0.0], 3) == cache.search(s, [3.0, 0.0], 3) and cache.stats()["hits"] == 1
        s.delete("v3")
        assert "v3" not in [r.id for r in cache.search(s, [3.0, 0.0], 3)] and cache.stats()["entries"] == 1
        assert "v3" not in ids(s.search([3.0, 0.0], 3)) and s.stats()["deleted"] == 1
        gone = s.delete_by_metadata({"n": {"$gte": 10}})
        assert (gone["count"], gone["ids"], ids(gone["deleted"].orderBy("id"))) == (2, ["v10", "v11"], ["v10", "v11"])
        s.update_metadata("v1", {"kind": "new"})
        assert ids(s.search([0.0, 0.0], 5, filter={"kind": "new"})) == ["v1"]
        path = str(tmp_path / "session")
        s.save(path)
        back = VectorSession.load(spark, path, as_of=NOW)
        assert back.stats()["deleted"] == 3 and back.vacuum() == 3 and back.stats()["deleted"] == 0
        assert back.add([{"id": "v3", "vector": [3.0, 0.0]}])["added"] == 1
        back.set_schema({"fields": {"n": "Number"}, "required": ["n"]})
        assert back.add([{"id": "w", "vector": [0.0, 0.0], "metadata": {"n": "x"}}])["failed"] == [("w", "n: expected number, found string")]
        assert back.train(2) is not None
        with pytest.raises(SessionError):
            s.delete("v3")
    with pytest.raises(SessionError):
        s.stats()


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"

    def send(*days):
        spark.createDataFrame([(f"2024-01-{d:02d} 00:00:00", "a", 1.0) for d in days], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        step = lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
        streams.drained(streams.windowed_counts(stream).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        return {str(r.start)[:10]: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("start").agg(F.max("n").alias("n")).collect()}

    assert send(10) == {"2024-01-10": 1}
    send(20)  # the watermark is the 19th from here on
    assert send(5, 19) == {"2024-01-10": 1, "2024-01-20": 1, "2024-01-19": 1}


def edits(spark, rows):
    return spark.createDataFrame([(i, [float(x)], d, v) for i, x, d, v in rows], "id string, embedding array<float>, deleted boolean, version long")


def test_change_feed(spark, tmp_path):
    path = str(tmp_path / "feed")

    def send(rows):
        edits(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(edits(spark, []).schema).parquet(f"{path}/in")
        streams.drained(streams.change_feed(stream, path, f"{path}/check"))
        return sorted((r.type, r.id, r.version) for r in streams.read_feed(spark, path).collect())

    assert send([("a", 1, False, 1), ("b", 1, False, 1), ("c", 1, True, 1)]) == [("inserted", "a", 1), ("inserted", "b", 1)]
    later = send([("a", 2, False, 3), ("a", 9, False, 2), ("b", 1, False, 2), ("d", 1, False, 1)])
    assert set(later) - {("inserted", "a", 1), ("inserted", "b", 1)} == {("updated", "a", 3), ("inserted", "d", 1)}
    end = send([("a", 2, True, 4), ("d", 7, False, 0)])
    assert ("deleted", "a", 4) in end and len(end) == len(later) + 1


def test_top_k_of_a_stream_takes_an_id_s_nearest_row_and_survives_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "top")
    rows = spark.createDataFrame([(1, [5.0]), (1, [1.0]), (2, [2.0]), (3, [3.0]), (2, [0.5])], "id long, embedding array<double>")
    rows.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
    run = lambda: streams.drained(streams.running_top_k(stream, [0.0], 2, f"{path}/out", f"{path}/check"))
    run()
    want = [(2, 0.5), (1, 1.0)]
    assert [(r.id, r.distance) for r in streams.latest_top_k(spark, f"{path}/out").orderBy("distance").collect()] == want
    for n in range(3):
        rows.where(F.lit(n == 0)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run()
    assert [(r.id, r.distance) for r in streams.latest_top_k(spark, f"{path}/out").orderBy("distance").collect()] == want
    # as if the last batch's commit had been lost: it runs again, from the state before it
    commits = sorted((tmp_path / "top/check/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink()
    run()
    assert [(r.id, r.distance) for r in streams.latest_top_k(spark, f"{path}/out").orderBy("distance").collect()] == want


def test_a_search_reads_the_probed_clusters_alone(spark, tmp_path):
    rnd = np.random.default_rng(3)
    points = [(f"p{i:03d}", (rnd.normal(size=2) * 0.1 + 10 * (i % 5)).tolist()) for i in range(200)]
    path = str(tmp_path / "clustered")
    with VectorSession(spark, as_of=NOW) as s:
        s.add([{"id": i, "vector": v} for i, v in points])
        exact = ids(s.search([10.0, 10.0], 5))
        assert len(s.train(5, seed=1).ids) == 5
        s.add([{"id": "new", "vector": [10.0, 10.0]}])
        assert ids(s.search([10.0, 10.0], 6, n_probe=1)) == ["new", *exact] == ids(s.search([10.0, 10.0], 6, n_probe=0))
        s.delete("new")
        s.save(path)
    back = VectorSession.load(spark, path, verify=True, as_of=NOW)
    found = back.search([10.0, 10.0], 5, n_probe=1)
    assert ids(found) == exact
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan or "PartitionFilters: [cluster_id" in plan
    probed = back._probed(back.corpus, [10.0, 10.0], 1)
    files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    assert files(probed) < files(back.corpus)
    got = back.search_batch({"x": [10.0, 10.0], "y": [0.0, 0.0]}, 5, n_probe=1)
    assert ids(got.where("query_id = 'x'").orderBy("rank")) == exact
    cache = ClusterCache(spark, path, capacity=2)
    for _ in range(2):
        assert ids(cache.search([10.0, 10.0], 5, n_probe=1)) == exact
    cache.search([0.0, 0.0], 5, n_probe=3).count()
    assert cache.stats()["hits"] >= 1 and cache.stats()["entries"] == 2
    cache.clear()


def test_a_crash_while_saving_leaves_the_old_corpus(spark, blobs, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.save(blobs, path)

    def crash(self, part, target):
        raise OSError("the power went")

    monkeypatch.setattr(store.BlobStore, "_rename", crash)
    with pytest.raises(OSError):
        store.save(blobs.limit(1), path)
    assert store.load(spark, path, verify=True)["corpus"].count() == 9
    monkeypatch.undo()
    store.save(blobs.limit(2), path)
    assert store.load(spark, path)["corpus"].count() == 2 and store.verify(spark, path) == {"valid": True, "errors": []}


def test_centroid_bytes():
    import struct
    import zlib

    c = ivf.Centroids(np.array([[1.5, 2.0], [3.0, -4.0]]), "cosine", ids=[4, 9])
    back = ivf.Centroids.from_bytes(c.to_bytes())
    assert (back.vectors == c.vectors).all() and (back.ids, back.metric) == ([4, 9], "cosine")
    old = ivf.MAGIC + struct.pack("<HHII", 1, 0, 1, 2) + np.array([1.0, 2.0], "<f4").tobytes()
    assert ivf.Centroids.from_bytes(old + struct.pack("<I", zlib.crc32(old))).vectors.tolist() == [[1.0, 2.0]]
    for bad in (b"", c.to_bytes()[:-1], b"x" * 40, c.to_bytes()[:20] + b"\0" + c.to_bytes()[21:]):
        with pytest.raises(ivf.TrainingError):
            ivf.Centroids.from_bytes(bad)


def test_balance_moves_exactly_what_is_over(spark):
    """All rows of a cluster at the cut have one distance: ties go by id."""
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [10.0, 0.0]) for i in range(4)]
    c = ivf.Centroids(np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 50.0]]))
    out = ivf.balance(ivf.assign(spark.createDataFrame(rows, "id long, embedding array<double>"), c), c, 0.5)
    moved = sorted(r.id for r in out.where("moved").collect())
    assert moved == list(range(18)) and out.count() == 44 and {r.cluster_id for r in out.where("moved").collect()} == {1}


def test_ranges_of_strings_and_of_many_cuts(spark):
    from vexel.functions import ranges

    df = spark.range(5000).select(F.format_string("vec_%08d", F.col("id")).alias("id")).withColumn("one", F.lit(1).cast("long"))
    for n in (1, 8, 300):
        got = ranges.running_sum(df, "id", "one", "upto", "all", n).collect()
        assert sorted(r.upto for r in got) == list(range(1, 5001)) and all(int(r.id[4:]) + 1 == r.upto for r in got)
    parts = ranges.with_range(df, "id", "part", 8).groupBy("part").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1200


def test_a_round_has_one_worker_a_task(blobs):
    """Assigning and summing are one kernel, with the sums of both one after the other."""
    c = ivf.Centroids(np.array([[0.0, 0.0], [5.0, 5.0]]), ids=[4, 7])
    one, two = ivf.nearest_sums(blobs, c), ivf.cluster_sums(ivf.assign(blobs, c))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def plain_ranks(ids, x, query_ids, queries, k, metric):
    """Every pair measured and sorted."""
    out = []
    for i, q in zip(query_ids.tolist(), queries):
        d = kernels.distances(x, q, metric)
        out += [(i, r, e) for e, r in sorted(zip(d.tolist(), ids.tolist()))[:k]]
    return out


@pytest.mark.parametrize("made", ["apart", "copies", "grid", "far", "tiny", "huge", "lone", "text"])
def test_products_leave_the_nearest(made, monkeypatch):
    rnd, k = np.random.default_rng(3), 5
    x, q, ids = rnd.normal(size=(700, 6)), rnd.normal(size=(40, 6)), rnd.permutation(700)
    if made == "copies":
        x[:500] = x[0]
        q[:30] = x[0]
    elif made == "grid":
        x, q = np.round(x), np.round(q)
    elif made == "far":
        x, q = x + 1e6, q + 1e6
    elif made in ("tiny", "huge"):
        x, q = (v * {"tiny": 1e-25, "huge": 1e25}[made] for v in (x, q))
    elif made == "lone":
        x, ids = x[:1], ids[:1]
    elif made == "text":
        ids = ids.astype(str)
    monkeypatch.setattr(kernels, "TILE_QUERIES", 16)
    monkeypatch.setattr(kernels, "TILE_ROWS", 128)
    monkeypatch.setattr(kernels, "MOST_PAIRS", 300)
    got = kernels.rank_batch(ids, x, np.arange(40), q, k, "l2")
    assert [tuple(r.values()) for r in got.to_pylist()] == plain_ranks(ids, x, np.arange(40), q, k, "l2")
    if made not in ("copies", "grid", "lone"):
        got = kernels.rank_batch(ids, x, np.arange(40), q, k, "cosine").to_pylist()
        want = plain_ranks(ids, x, np.arange(40), q, k, "cosine")
        assert [r["distance"] for r in got] == pytest.approx([w[2] for w in want], abs=1e-12) and [r["query_id"] for r in got] == [w[0] for w in want]


def test_few_pairs_are_measured(monkeypatch):
    """Products leave a few rows a query, of copies too; numbers that aren't finite are measured all."""
    rnd, pairs = np.random.default_rng(5), []
    x = rnd.normal(size=(2000, 16))
    x[:600] = x[0]
    one = kernels.measured
    monkeypatch.setattr(kernels, "measured", lambda a, b, metric: pairs.append(len(a)) or one(a, b, metric))
    assert kernels.rank_batch(np.arange(2000), x, np.arange(2000), x, 4, "l2").num_rows == 8000
    assert 8000 <= sum(pairs) < 40_000
    x[0, 0] = np.inf
    assert kernels.rank_batch(np.arange(2000), x, np.arange(10), x[1:11], 4, "l2").num_rows == 40


def test_blocks_of_any_numbers(spark, monkeypatch):
    """Vectors of 32 bits are sent as such, others whole; few rows a block."""
    monkeypatch.setattr(knn, "BATCH_QUERIES", 4)
    monkeypatch.setattr(knn, "PRODUCT_ROWS", 40)
    rnd = np.random.default_rng(11)
    for x in (rnd.normal(size=(150, 3)), rnd.normal(size=(150, 3)).astype(np.float32).astype(float)):
        c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
        monkeypatch.setattr(knn, "collect_queries", lambda q: None)
        got = knn.nearest_batch(c, c.select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), 3)
        want = plain_ranks(np.arange(150), x, np.arange(150), x, 3, "l2")
        assert sorted((r.query_id, r.id, r.distance) for r in got.collect()) == sorted(want)


def test_graph_search_and_insert(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(400, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").cache()
    edges = graph.build(corpus, m=6).cache()
    assert edges.agg(F.max("layer")).first()[0] >= 1
    hits = 0
    for q in rnd.normal(size=(5, 8)):
        want = np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:10].tolist()
        hits += len(set(want) & set(ids(graph.search(edges, corpus, q.tolist(), 10, ef=48))))
    assert hits >= 45
    some = {i: q.tolist() for i, q in enumerate(rnd.normal(size=(3, 8)))}
    tables, where = [], type(corpus).where
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(corpus), "where", lambda self, *a: tables.append(1) or where(self, *a))
        one = {i: ids(graph.search(edges, corpus, q, 10)) for i, q in some.items()}
        alone = len(tables)
        together = graph.search_batch(edges, corpus, some, 10).orderBy("query_id", "distance", "id").collect()
    assert {i: [r.id for r in together if r.query_id == i] for i in some} == one
    assert len(tables) - alone < 0.7 * alone  # the beams share reads
    assert graph.search(edges.limit(0), corpus, [0.0] * 8, 3).count() == 0 and graph.build(corpus.limit(1)).count() == 0


def test_cbor():
    from vexel.functions import cbor

    known = {0: "00", 23: "17", 24: "1818", 1000: "1903e8", -1: "20", -1000: "3903e7", 1.1: "fb3ff199999999999a", "ü": "62c3bc", b"\1\2": "420102", True: "f5", None: "f6"}
    for value, data in known.items():
        assert cbor.encode(value).hex() == data and cbor.decode(bytes.fromhex(data)) == value
    assert cbor.encode([1, [2, 3]]).hex() == "8201820203" and cbor.encode({"a": 1, "b": [2]}).hex() == "a26161016162" + "8102"
    assert cbor.encode(cbor.Single(100000.0)).hex() == "fa47c35000"
    assert cbor.decode(bytes.fromhex("9f018202039f0405ffff")) == [1, [2, 3], [4, 5]] and cbor.decode(bytes.fromhex("5f42010243030405ff")) == b"\1\2\3\4\5"
    assert cbor.decode(bytes.fromhex("f93c00")) == 1.0 and cbor.decode(bytes.fromhex("c11a514b67b0")) == 1363896240
    for bad in ("", "18", "62c3", "a16161", "ff", "8201", "0000", "1c", "61ff", "bf6161ff", "a18001"):
        with pytest.raises(cbor.CborError):
            cbor.decode(bytes.fromhex(bad))
    with pytest.raises(cbor.CborError):
        cbor.encode(object())


def test_cbor_rows(spark):
    from vexel.functions import cbor

    df = spark.createDataFrame([("a", [1.5, 2.5], 3, None, ("x", True)), ("b", [], None, "t", ("y", None))], "id string, values array<float>, n long, s string, m struct<k: string, f: boolean>")
    assert cbor.decode_rows(cbor.encode_rows(df), df.schema).collect() == df.collect()
    more = cbor.decode_rows(cbor.encode_rows(df), "s string, other double, n double").collect()
    assert [tuple(r) for r in more] == [(None, None, 3.0), ("t", None, None)]


def test_upkeep():
    called, failing = [], iter([False, True, False])
    loop = maintenance.Loop(lambda: called.append(1) if not next(failing) else 1 / 0, 0.01)
    with loop:
        for _ in range(500):
            if loop.runs >= 3:
                break
            time.sleep(0.01)
    assert len(called) == 2 and loop.failures >= 1 and loop._thread is None
    with pytest.raises(ValueError):
        maintenance.Loop(print, 0)
    alerts, heard = maintenance.Alerts(), []
    alerts.on(heard.append)
    assert [alerts.see({"status": x}) for x in ("ok", "warning", "warning", "ok", "ok")] == [0, 1, 1, 1, 0]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

    with pytest.raises(store.StoreError):
        store.shared_folder(Session(), "x")


def test_filters_refuse_what_they_do_not_know():
    for bad in ({"a": {"$near": 1}}, {"$nor": []}, {"a": {}}, {"a": {"$gt": 1, "$gte": 1}}):
        with pytest.raises(ValueError):
            compile_filter(bad)


def test_bodies_that_are_no_rows(spark):
    texts = [None, "", "  ", "{", "[1]", "null", '{"vector": [1]}', '{"id": "a", "vector": [1, 2], "metadata": {"k": 1}}', '{"id": "b"}', '{"id": "c", "vector": "x"}', '{"id": "' + "y" * 100 + '"}']
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, body string")
    rows, refused = bodies.parse(df, most_bytes=80)
    found = {r.n: (r.id, r.embedding, None if r.metadata is None else r.metadata.toPython()) for r in rows.collect()}
    assert found == {7: ("a", [1.0, 2.0], {"k": 1}), 8: ("b", None, None)}
    said = {r.n: r.reason for r in refused.collect()}
    assert {n: said[n] for n in (0, 1, 2, 3, 4, 6, 9, 10)} == {0: "empty", 1: "empty", 2: "empty", 3: "malformed", 4: "malformed", 6: "no id", 9: "malformed", 10: "too large"}
    assert said[5] in ("malformed", "no id") and len(said) + len(found) == len(texts)


def test_saved_graph(spark, tmp_path):
    path, kind = f"file://{tmp_path}/graph", "layer int, src string, dst string, distance double"
    edges = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "a", 1.0), (1, "a", "b", 1.0)], kind)
    with pytest.raises(store.StoreError, match="no graph"):
        graphs.load(spark, path)
    graphs.save(edges, path)
    graphs.save_changes(spark.createDataFrame([(0, "a", "c", 0.5), (0, "b", "c", 9.0)], kind), spark.createDataFrame([("a",)], "id string"), path)
    want = [(0, "a", "c", 0.5), (0, "b", "a", 1.0)]  # b isn't among the nodes that changed
    assert sorted(map(tuple, graphs.load(spark, path, verify=True).collect())) == want
    m = graphs.merge(spark, path)
    assert m["changes"] == [] and sorted(map(tuple, graphs.load(spark, path).collect())) == want and graphs.verify(spark, path) == {"valid": True, "errors": []}
    assert {k.split("/")[0] for k in store.BlobStore(spark, path).list() if "/" in k} == {m["base"]["data"]}
    graphs.save(edges.limit(0), path)
    assert graphs.load(spark, path, verify=True).count() == 0


def test_a_loop_starts_again():
    ran = []
    loop = maintenance.Loop(lambda: ran.append(1), 3600)
    for n in (1, 2):
        loop.start(now=True)
        loop.stop()
        assert loop.runs == len(ran) == n
