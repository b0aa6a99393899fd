"""Statistics of a corpus, of its clusters and of searches; every one is a single aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import running_sum
from .hybrid import WEEK, age_seconds, is_recent, with_tier

HOUR, DAY = 3600, 86_400


def tier_counts(corpus: DataFrame, as_of, threshold: int = WEEK) -> DataFrame:
    return corpus.agg(F.count_if(is_recent(as_of, threshold)).alias("recent"), F.count_if(~is_recent(as_of, threshold)).alias("historical"), F.count("*").alias("total"))


def deletion_counts(corpus: DataFrame, tombstones: DataFrame, as_of, threshold: int = WEEK) -> DataFrame:
    """By tier: active and deleted rows."""
    dead = tombstones.select("id").distinct().withColumn("dead", F.lit(True))
    rows = with_tier(corpus, as_of, threshold).join(dead, "id", "left")
    return rows.groupBy("tier").agg(F.count_if(F.col("dead").isNull()).alias("active"), F.count_if("dead").alias("deleted"))


def session_stats(corpus: DataFrame, tombstones: DataFrame, as_of, threshold: int = WEEK) -> DataFrame:
    """One row: active and deleted rows in all and by tier, and the bytes that the active vectors take."""
    dead = tombstones.select("id").distinct().withColumn("dead", F.lit(True))
    rows = with_tier(corpus, as_of, threshold).join(dead, "id", "left").withColumn("live", F.col("dead").isNull())
    of = lambda tier, live: F.count_if((F.col("tier") == tier) & (F.col("live") == live))
    return rows.agg(
        F.count_if("live").alias("active"), F.count_if(~F.col("live")).alias("deleted"),
        of("recent", True).alias("recent"), of("historical", True).alias("historical"), of("recent", False).alias("recent_deleted"), of("historical", False).alias("historical_deleted"),
        F.coalesce(F.sum(F.when(F.col("live"), F.size("embedding") * 4)), F.lit(0)).alias("vector_bytes"),
    )


def age_distribution(corpus: DataFrame, as_of) -> DataFrame:
    """One row: counts by age, in all, newest and oldest (as_of for no rows)."""
    age = age_seconds(as_of)
    now = F.lit(str(as_of)).cast("timestamp")
    return corpus.agg(
        F.count_if(age < HOUR).alias("last_hour"), F.count_if((age >= HOUR) & (age < DAY)).alias("last_day"), F.count_if((age >= DAY) & (age < WEEK)).alias("last_week"), F.count_if(age >= WEEK).alias("older"),
        F.count("*").alias("total"), F.coalesce(F.max("ts"), now).alias("newest"), F.coalesce(F.min("ts"), now).alias("oldest"),
    )


def average_age_ms(corpus: DataFrame, as_of) -> DataFrame:
    return corpus.agg(F.coalesce(F.avg(age_seconds(as_of) * 1000), F.lit(0.0)).alias("avg_age_ms"))


def new_since(corpus: DataFrame, since) -> DataFrame:
    return corpus.where(F.col("ts") > F.lit(str(since)).cast("timestamp")).agg(F.count("*").alias("n"))


def memory_estimate(corpus: DataFrame, per_row: int = 41) -> DataFrame:
    """Bytes: of the elements (4 each) and per_row of bookkeeping."""
    return corpus.agg(F.coalesce(F.sum(F.size("embedding") * 4 + per_row), F.lit(0)).cast("long").alias("bytes"))


def latency_stats(runs: DataFrame, value: str = "ms", results: str | None = None) -> DataFrame:
    """Count, mean, and the order statistics at floor(n / 2) and at floor(0.99 n) from 0, the last one at most; no interpolation.

    Equal values are counted first, and the counts added up by ranges of the values, so no task has all of them."""
    by = runs.groupBy(value).agg(F.count("*").alias("n"))
    ranked = running_sum(by, value, "n", "upto", "all")
    at = lambda share: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * share), F.col("all") - 1), F.col(value)))
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), at(0.5).alias("p50"), at(0.99).alias("p99"))


def cache_stats(log: DataFrame, hit: str = "hit") -> DataFrame:
    n = F.count("*")
    return log.agg(F.count_if(hit).alias("hits"), F.count_if(~F.col(hit)).alias("misses"), F.when(n == 0, 0.0).otherwise(F.count_if(hit) / n).alias("hit_rate"))


def health(corpus: DataFrame, as_of, most_recent: int = 1000, most_bytes: int = 1 << 30, threshold: int = WEEK) -> DataFrame:
    """One row: status ok or warning, by the backlog of recent rows and the bytes of the vectors."""
    t = tier_counts(corpus, as_of, threshold).crossJoin(memory_estimate(corpus))
    return t.select("recent", "bytes", F.when((F.col("recent") > most_recent) | (F.col("bytes") >= most_bytes), "warning").otherwise("ok").alias("status"))


def orphans(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys of left that right doesn't have."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def running_means(log: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """Adds the mean of the values so far, of each group in its order. Sums and counts of ranges of the order are added first, so a
    group with a third of all rows is spread over its ranges."""
    rows = log.withColumns({"_one": F.col(value).isNotNull().cast("long"), "_value": F.coalesce(F.col(value).cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))})
    rows = running_sum(running_sum(rows, order, "_one", "_n", "_all", by=by), order, "_value", "_sum", "_total", by=by)
    return rows.withColumn("mean", (F.col("_sum").cast("double") / F.col("_n"))).drop("_one", "_value", "_n", "_sum", "_all", "_total")


def stored_bytes(blobs: DataFrame) -> DataFrame:
    """blobs: as BlobStore.table() or the binaryFile source give them; the contents are not read."""
    return blobs.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
