"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shared_dir

#: Rounds after which something is wrong: they grow with the logarithm of the longest path.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any order and of any type that sorts; gives (node, root): root is the least node of its component.

    Large stars and small stars in turn (Kiveris and others, 2014): every node sends its larger neighbours, then its
    smaller ones, to the least node it knows, until all hang at one root each. Every round is written to the checkpoint
    folder, so that plans stay short and a lost executor costs no earlier round. A hub may have a third of all edges.
    """
    shared_dir(edges.sparkSession)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())

    # a: the larger node
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = state(e)
    for _ in range(MOST_ROUNDS):
        if not last[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = salted_join(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, "a", "b").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"), F.col("a").alias("c"), "m")
        small = small.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = small.checkpoint()
        now = state(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
