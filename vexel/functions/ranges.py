"""Ranges of a column: how to rank rows without a task that sees them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .kernels import over_batches

#: Ranges at least, rows of a range about, and values drawn for each cut.
LEAST_RANGES, RANGE_ROWS, DRAWN = 64, 1 << 20, 64
#: Cuts that are compared one by one in the plan; more are looked up in a kernel.
FEW_CUTS = 128


def cuts_of(df: DataFrame, column: str, ranges: int) -> list:
    """Values that cut the column, of any type that sorts, into ranges of about as many rows: those with the least hashes are drawn, a
    bounded number, the same ones in every run."""
    if ranges < 2:
        return []
    drawn = sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(DRAWN * ranges).collect())
    return sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []


def with_range(df: DataFrame, column: str, part: str, ranges: int | None = None) -> DataFrame:
    """Adds part, the number of the column's range (the first for null); ranges have about as many rows each (more, if one value has
    many). None: as many as the rows ask for."""
    ranges = max(LEAST_RANGES, -(-df.count() // RANGE_ROWS)) if ranges is None else ranges
    cuts = cuts_of(df, column, ranges)
    if not cuts:
        return df.withColumn(part, F.lit(0))
    if len(cuts) <= FEW_CUTS:
        return df.withColumn(part, F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.coalesce(F.col(column), F.lit(cuts[0])))) - F.col(column).isNull().cast("int"))
    df = df.drop(part)
    names, edges = df.columns, np.array(cuts)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        values = b.column(names.index(column)).fill_null(cuts[0]).to_numpy(zero_copy_only=False).astype(edges.dtype)
        at = np.searchsorted(edges, values, side="right") * np.asarray(b.column(names.index(column)).is_valid())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*names, part])

    return over_batches(df, run, T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())]))


def running_sum(df: DataFrame, column: str, value: str, upto: str, total: str, ranges: int | None = None, by: str | None = None) -> DataFrame:
    """Adds the sum of value over the rows up to each one in the order of column (unlike values), and over all; with by, of its group.
    Sums of ranges are added first: one task has a row a range (and group), the others the rows of one range."""
    keys = ["_part"] if by is None else [by, "_part"]
    rows = with_range(df, column, "_part", ranges)
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys[:-1])
    sums = sums.select(*keys, (F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(w).alias(total))
    own = F.sum(value).over(Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    if by is None:
        joined = rows.join(sums, "_part")
    else:
        sums = sums.withColumnRenamed(by, "_by").withColumnRenamed("_part", "_at")
        joined = rows.join(sums, rows[by].eqNullSafe(sums["_by"]) & (rows["_part"] == sums["_at"])).drop("_by", "_at")
    return joined.withColumn(upto, F.col("_before") + own).drop("_part", "_before")
