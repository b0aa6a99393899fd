"""Merging of result sets (id, distance, score, ...) and relevance scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import VariantField
from .hybrid import instant


def union(results: list[DataFrame]) -> DataFrame:
    """All rows, with source_idx of the set that each is from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.withColumn("source_idx", F.lit(i)) for i, r in enumerate(results)])


def deduplicate(results: DataFrame) -> DataFrame:
    """One row an id, the one with the least distance (of the first set, if equal), by distance."""
    others = [c for c in results.columns if c != "id"]
    order = F.struct("distance", *(["source_idx"] if "source_idx" in others else []))
    return results.groupBy("id").agg(F.min_by(F.struct(*others), order).alias("r")).select("id", "r.*").orderBy("distance", "id")


def merge_search_results(results: list[DataFrame], k: int) -> DataFrame:
    return deduplicate(union(results)).orderBy("distance", "id").limit(k)


def merge(results: list[DataFrame], k: int, strategy: str = "best", weights: list[float] | None = None) -> DataFrame:
    """(id, score, distance): best takes the row with the largest score of an id, average and weighted the means of score and
    distance over its rows; a set without a weight has 1. The best k by score."""
    rows = union(results)
    if strategy == "best":
        out = rows.groupBy("id").agg(F.max("score").alias("score"), F.max_by("distance", F.struct(F.col("score"), -F.col("source_idx"))).alias("distance"))
    elif strategy in ("average", "weighted"):
        w = weights or []
        weight = F.lit(1.0) if strategy == "average" else F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in w]) if w else F.array().cast("array<double>"), F.col("source_idx")), F.lit(1.0))
        rows = rows.withColumn("w", weight)
        total = F.sum("w")
        mean = lambda c: F.when(total > 0, F.sum(F.col(c) * F.col("w")) / total).otherwise(F.lit(0.0))
        out = rows.groupBy("id").agg(mean("score").alias("score"), mean("distance").alias("distance"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return out.orderBy(F.desc("score"), "id").limit(k)


def similarity() -> Column:
    return 1 - F.col("distance")


def number_at(metadata: str, path: str) -> Column:
    """A number, or text that is one, in a VARIANT column."""
    v = VariantField.at(F.col(metadata), path)
    return F.coalesce(v.number(), F.try_variant_get(v.value, "$", "string").try_cast("double"))


def boosted(metadata: str = "metadata") -> Column:
    """Similarity times the metadata's boost, if it is a number."""
    return similarity() * F.coalesce(number_at(metadata, "boost"), F.lit(1.0))


def time_decayed(as_of, half_life_seconds: float, ts: Column | None = None, metadata: str = "metadata") -> Column:
    """Similarity halved for every half-life of age; no decay for the future or a timestamp that can't be read."""
    when = F.try_to_timestamp(VariantField.at(F.col(metadata), "timestamp").text()) if ts is None else ts
    age = F.greatest(F.lit(0.0), instant(as_of).cast("double") - when.cast("double"))
    return similarity() * F.coalesce(F.pow(F.lit(0.5), age / F.lit(float(half_life_seconds))), F.lit(1.0))


def popular(views: Column) -> Column:
    """Similarity raised by the logarithm of the views."""
    return similarity() * (1 + F.log1p(F.coalesce(views.cast("double"), F.lit(0.0))) / 10)


def combined(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores; similarity if the weights add up to 0 or less."""
    total = sum(w for _, w in parts)
    if total <= 0:
        return similarity()
    return reduce(lambda a, b: a + b, [s * F.lit(float(w)) for s, w in parts]) / F.lit(float(total))


def rescore(results: DataFrame, score: Column, k: int) -> DataFrame:
    return results.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)
