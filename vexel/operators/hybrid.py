"""Two tiers by age: recent rows and historical ones. The tier is a function of ts and as_of, so a row is in one of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import knn

WEEK = 7 * 86_400
RECENT, HISTORICAL = "recent", "historical"


def instant(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def age_seconds(as_of: datetime | str, ts: str = "ts") -> Column:
    """Seconds since ts, 0 for one in the future."""
    return F.greatest(F.lit(0.0), instant(as_of).cast("double") - F.col(ts).cast("double"))


def is_recent(as_of: datetime | str, threshold: int = WEEK, ts: str = "ts") -> Column:
    """As a bound on ts alone, so that the scan can skip by it."""
    return F.col(ts) > (instant(as_of) - F.make_interval(secs=F.lit(threshold)))


def with_tier(corpus: DataFrame, as_of: datetime | str, threshold: int = WEEK) -> DataFrame:
    return corpus.withColumn("tier", F.when(is_recent(as_of, threshold), RECENT).otherwise(HISTORICAL))


def search(corpus: DataFrame, q: list[float], k: int, as_of: datetime | str, threshold: int = WEEK, recent_k: int | None = None, historical_k: int | None = None, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The best recent_k and historical_k (k each) rows of the tiers, together ranked and cut to k; a tier with 0 is not read. Where
    each tier may fill the result, that is one scan for the k best of both."""
    tiered = with_tier(corpus, as_of, threshold)
    if all(n is None or n >= k for n in (recent_k, historical_k)):
        return knn.nearest(tiered, q, k, metric, where=where)
    sides = [(is_recent(as_of, threshold), k if recent_k is None else recent_k), (~is_recent(as_of, threshold), k if historical_k is None else historical_k)]
    found = [knn.nearest(tiered, q, n, metric, where=side if where is None else side & where) for side, n in sides if n > 0]
    if not found:
        return knn.ranked(tiered, q, metric).limit(0)
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return out.orderBy("distance", "id").limit(k)


def search_filtered(corpus: DataFrame, q: list[float], k: int, where: Column, mode: str = "pre", oversample: int = 3, metric: str = "l2") -> DataFrame:
    """pre: the k nearest of the rows that where holds for. post: those of them among the oversample * k nearest rows of all,
    k at most and maybe fewer."""
    if mode == "pre":
        return knn.nearest(corpus, q, k, metric, where=where)
    if mode != "post":
        raise ValueError(f"unknown mode {mode}")
    return knn.nearest(corpus, q, k * oversample, metric).where(where).orderBy("distance", "id").limit(k)


def search_weighted(corpus: DataFrame, q: list[float], k: int, as_of: datetime | str, recent_weight: float = 1.0, historical_weight: float = 1.0, threshold: int = WEEK, scoring: str = "inverse") -> DataFrame:
    """k of each tier, score times the tier's weight, the best k by that. scoring: inverse, 1 / (1 + d), or linear, 1 - d."""
    tiered = with_tier(corpus, as_of, threshold)
    both = [knn.nearest(tiered, q, k, where=side).withColumn("weight", F.lit(float(w))) for side, w in ((is_recent(as_of, threshold), recent_weight), (~is_recent(as_of, threshold), historical_weight))]
    base = vectors.score("distance") if scoring == "inverse" else 1 - F.col("distance")
    return both[0].unionByName(both[1]).withColumn("score", base * F.col("weight")).orderBy(F.desc("score"), "id").limit(k)


def migration(corpus: DataFrame, before: datetime | str, as_of: datetime | str, threshold: int = WEEK) -> DataFrame:
    """Rows that went from recent to historical between two instants."""
    return corpus.where(is_recent(before, threshold) & ~is_recent(as_of, threshold))


def plan_search(n_recent: int, n_historical: int) -> dict:
    """Which tiers to search and how widely, by their sizes."""
    total = n_recent + n_historical
    level = 0 if total < 1000 else 1 if total < 10_000 else 2
    return {"search_recent": n_recent > 0, "search_historical": n_historical > 0, "n_probe": (5, 10, 20)[level], "ef": (50, 100, 200)[level]}


def suggest_search(k: int, n_recent: int, n_historical: int) -> dict:
    level = 0 if k < 10 else 1 if k < 50 else 2
    return {"search_recent": n_recent > 0, "search_historical": n_historical > 0, "n_probe": (5, 10, 20)[level], "ef": (50, 100, 200)[level]}
