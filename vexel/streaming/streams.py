"""Streams of vector rows: running top-k, re-tiering, change feeds and windowed counts, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors
from ..operators import hybrid, knn
from ..sources.store import BlobStore, shared_folder


def running_top_k(stream: DataFrame, q: list[float], k: int, path: str, checkpoint: str, metric: str = "l2") -> StreamingQuery:
    """Keeps the k nearest ids seen so far, each at its least distance, in path/batch=N of the last batch N. A batch adds k rows to the
    state at most; a batch that is run again after a failure writes the same folder again, from the one before it. States older
    than that are deleted."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        # an id may come with several rows: its nearest one counts, so ids are cut to k, not rows
        best = knn.ranked(batch, q, metric).groupBy("id").agg(F.min("distance").alias("distance"))
        if n > 0:
            best = best.unionByName(spark.read.parquet(f"{path}/batch={n - 1}").select("id", "distance"))
        best = best.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)
        best.withColumn("score", vectors.score("distance")).write.mode("overwrite").parquet(f"{path}/batch={n}")
        if n > 1:
            BlobStore(spark, path).delete(f"batch={n - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_top_k(spark: SparkSession, path: str) -> DataFrame:
    """What running_top_k() has now."""
    state = spark.read.parquet(path)
    last = state.agg(F.max("batch")).first()[0]
    return state.where(F.col("batch") == last).drop("batch")


def retier(stream: DataFrame, as_of, path: str, checkpoint: str, threshold: int = hybrid.WEEK) -> StreamingQuery:
    """Appends rows to a table partitioned by their tier as of an instant."""
    return hybrid.with_tier(stream, as_of, threshold).writeStream.format("parquet").partitionBy("tier").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(before: DataFrame, after: DataFrame, as_of_before, as_of_after, threshold: int = hybrid.WEEK) -> DataFrame:
    """(type, id, from, to): inserted, deleted and updated rows between two versions of a corpus, and migrated ones."""
    a = hybrid.with_tier(before, as_of_before, threshold).select("id", F.col("tier").alias("from"), F.xxhash64("embedding").alias("a"))
    b = hybrid.with_tier(after, as_of_after, threshold).select("id", F.col("tier").alias("to"), F.xxhash64("embedding").alias("b"))
    kind = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated").when(F.col("from") != F.col("to"), "migrated")
    return a.join(b, "id", "full").select(kind.alias("type"), "id", "from", "to").where("type IS NOT NULL")


def change_feed(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream of edits (id, embedding, ts, deleted, version) becomes a feed of changes (type, id, version) in path/feed/batch=N, by
    what the last version of each id was: inserted, updated, deleted, or nothing for an edit that changes nothing or is older
    than what is known. State is one row an id (hash of the vector), in path/state/batch=N. A batch that is run again after
    a failure starts from the state before it, so the feed has each change once. every: a trigger's interval; None: what is there."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        w = F.max_by(F.struct("deleted", F.xxhash64("embedding").alias("hash")), "version")
        new = batch.groupBy("id").agg(F.max("version").alias("version"), w.alias("now"))
        kinds = "id {}, version bigint, deleted boolean, hash bigint".format(batch.schema["id"].dataType.simpleString())
        old = spark.read.parquet(f"{path}/state/batch={n - 1}") if n > 0 else spark.createDataFrame([], kinds)
        both = new.join(old.select("id", F.col("version").alias("v0"), F.col("deleted").alias("gone"), F.col("hash").alias("h0")), "id", "full")
        late = F.col("version").isNull() | (F.col("v0") >= F.col("version"))
        there, was = ~F.coalesce(F.col("now.deleted"), F.lit(False)), F.col("v0").isNotNull() & ~F.coalesce(F.col("gone"), F.lit(True))
        kind = F.when(late, None).when(there & ~was, "inserted").when(there & (F.col("now.hash") != F.col("h0")), "updated").when(~there & was, "deleted")
        both.select(kind.alias("type"), "id", "version").where("type IS NOT NULL").write.mode("overwrite").parquet(f"{path}/feed/batch={n}")
        keep = lambda a, b: F.when(late, F.col(a)).otherwise(b)
        both.select("id", keep("v0", F.col("version")).alias("version"), keep("gone", ~there).alias("deleted"), keep("h0", F.col("now.hash")).alias("hash")).write.mode("overwrite").parquet(f"{path}/state/batch={n}")
        if n > 1:
            BlobStore(spark, path).delete(f"state/batch={n - 2}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """All changes that change_feed() has written."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/feed")


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows and sums of value by window and event_type; rows later than late are dropped when the input is a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drained(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of the session."""
    return shared_folder(spark, "stream")
