"""Operator 9: sources mixed to target weights by a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, buckets_for, fresh, key_bucket, numbered, ordinals, running, seeded_key, written

#: Weights of the sources in the order of their names, repeating, and how each weight moves over the training:
#: weight * (1 + slope * (1 - 2 t)) at time t of 0 to 1. Its integral is the weight, whatever the slope.
WEIGHTS, SLOPES = (5.0, 2.0, 1.0), (0.5, 0.0, -0.5)
MAX_REPEATS = 3


def pick(values: tuple[float, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), (index % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds rank (by code point, null last) and target.

    Targets share the total by weight; none exceeds max_repeats times its source's size, and the excess is reshared by
    weight until none is above. That is water filling: with sources in the order of max_repeats * size / weight, the
    first ones that the level of the rest would overfill stop at their limit. One row a source: a small table.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", pick(weights, F.col("rank"))).withColumn("most", F.col("source_size") * max_repeats)
    filled = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), "rank")
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(rest))
    # sources below their limit come last; the first of them has the level of them all
    open_ = F.when(F.col("weight") * F.col("level") < F.col("most"), F.col("level"))
    t = t.withColumn("level", F.first(open_, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("most").cast("double")
    return t.select("source", "source_size", "rank", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("weight") * F.col("level"))).alias("target"))


def when_reached(share: Column, slope: Column) -> Column:
    """The time by which a source has been asked for this share of its tokens: the inverse of t + slope * (t - t * t)."""
    return F.when(slope == 0, share).otherwise(((slope + 1) - F.sqrt(F.greatest((slope + 1) * (slope + 1) - slope * 4 * share, F.lit(0.0)))) / (slope * 2))


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """Adds size (words), source_size, target, copies (0 to max_repeats), taken (copies * size), start (the words of its source before
    it in the seeded order) and slope (of its source's weight over the training) to every row.

    A source whose target is q times its size, q = a + f with a whole, takes all its documents a times, and once more
    those that come first in the seeded order, until f of its words are reached (a document counts as reached if its
    middle is). So what is taken differs from the target by half a document at most.

    The seeded order goes by the id, the text's digest and, for rows that are equal in these, their number among them, so a
    third of all rows may share an id or be copies of one row. Rows are written once, with what the steps need.

    Null sources are a source of their own, last in order; null and empty texts have size 0, are taken a times and add
    nothing; very long texts count whole; if all texts are empty, targets are 0; an empty table gives an empty result.
    Rows with the same id and text are rows of their own. A source with a third of the rows is spread over ranges of the
    seeded key. Input columns with the added names are replaced. Needs doc_id and source, and text, or size and digest in its place.
    """
    words = F.col("size") if "size" in docs.columns and "text" not in docs.columns else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest_ = F.col("digest") if "text" not in docs.columns else digest(F.col("text"))
    docs = docs.drop("source_size", "target", "copies", "taken", "start", "slope")
    row, same, nth, key, bucket, src, none, before, total = fresh([*docs.columns, "size"], "row", "same", "nth", "key", "bucket", "src", "none", "before", "total")
    marked = docs.withColumns({"size": words, src: F.coalesce("source", F.lit("")), none: F.col("source").isNull().cast("int"), same: seeded_key(seed, F.col("doc_id"), digest_, F.col("source"))})
    marked = numbered(marked, "mix-rows", row)
    n_buckets = buckets_for(marked.count())
    out = ordinals(marked, same, row, nth).withColumn(key, seeded_key(seed, F.col(same), F.col(nth)))
    out = out.withColumn(bucket, key_bucket(F.col(key), n_buckets)).drop(same, nth)
    sums = marked.groupBy("source", none, src).agg(F.sum("size").alias("source_size")).select("source", "source_size")
    targets = source_targets(sums, weights, max_repeats).select(F.coalesce("source", F.lit("")).alias(src), F.col("source").isNull().cast("int").alias(none), "target", pick(slopes, F.col("rank")).alias("slope"))
    order = [F.col(key), F.col(row)]
    out = running(out, [none, src], bucket, order, "size", before, total, targets).withColumnRenamed(total, "source_size")
    ratio = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    whole = F.floor(ratio)
    once_more = (F.col(before) + F.col("size") / 2) < (ratio - whole) * F.col("source_size")
    out = out.withColumn("copies", F.least(F.lit(max_repeats), whole + F.when(once_more & (F.col("size") > 0), 1).otherwise(0)).cast("int"))
    out = out.withColumn("taken", F.col("copies") * F.col("size")).withColumnRenamed(before, "start")
    return out.drop(row, key, bucket, src, none)


def positions(mixed: DataFrame) -> DataFrame:
    """One row for each copy that mix() takes, with copy (from 0) and position (0 to 1), sorted by position.

    A source's demand up to time t is its target times the integral of its weight to t; the copy that starts at word
    number s of what its source gives is due when the demand reaches s. The sort is by ranges, over all executors, and by
    exact positions; ties (of size 0, or across sources) go by source, id and copy. Rows of size 0 are due when the words
    before them are. Nulls are as in mix().
    """
    out = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.least(F.lit(1.0), F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("start")) / F.col("target")).otherwise(F.lit(0.0)))
    return out.withColumn("position", when_reached(share, F.col("slope"))).orderBy("position", "source", "doc_id", "copy")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    # texts are read once: their words and digests go on from here
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = mix(docs.select("doc_id", "source", size.alias("size"), digest(F.col("text")).alias("digest")))
    share = F.least(F.lit(1.0), F.when(F.col("target") > 0, F.col("start") / F.col("target")).otherwise(F.lit(0.0)))
    out = out.withColumn("exact", F.when(F.col("copies") > 0, when_reached(share, F.col("slope")))).orderBy(F.col("exact").asc_nulls_last(), "source", "doc_id")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "copies", F.round("exact", 6).alias("position"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, 'null')) AS same FROM documents),
o AS (SELECT *, md5('mix:' || same || ':' || (row_number() OVER (PARTITION BY same) - 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rank % 3 + 1] AS weight, [0.5::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE][rank % 3 + 1] AS slope, source_size * 3 AS most FROM r),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, (SELECT arg_min(level, most / weight) FROM f WHERE weight * level < most) AS lvl FROM f),
t AS (SELECT source, source_size, slope, CASE WHEN lvl IS NULL THEN most::DOUBLE ELSE least(most::DOUBLE, weight * lvl) END AS target FROM g),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM o d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS ratio, CASE WHEN target > 0 THEN least(1.0::DOUBLE, before / target) ELSE 0.0::DOUBLE END AS share FROM c),
x AS (SELECT *, least(3, floor(ratio)::INT + CASE WHEN size > 0 AND before + size / 2 < (ratio - floor(ratio)) * source_size THEN 1 ELSE 0 END)::INT AS copies FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN 0.0::DOUBLE + round(CASE WHEN slope = 0 THEN share ELSE ((slope + 1) - sqrt(greatest((slope + 1) * (slope + 1) - slope * 4 * share, 0.0::DOUBLE))) / (slope * 2) END, 6) END AS position
FROM x
"""
