"""What the operators of this folder share: names, the shared folder, released shuffles, running totals."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: what lies between the ASCII white space characters 20 and 09 to 0D. bytes.split() splits by the same six.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that no column of the input has, whatever its case."""
    low = {x.lower() for x in taken}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, which all executors must reach; without it there is no place for tables between
    stages, which is an error: a folder of this machine's would be out of reach on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/vexel-{sc.applicationId}"  # one machine: driver and executors are one process
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vexel-{name}-{uuid.uuid4().hex}"
    remember(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


#: Folders that this process wrote, and the catalog's names of those that have one, for sweep().
_WRITTEN: list[tuple[str, str | None]] = []


def remember(path: str, table: str | None = None) -> None:
    _WRITTEN.append((path, table))


def remembered() -> int:
    """How many tables there are, for sweep()."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables that this process wrote to the shared folder after the first since, but for the last keep;
    results that read them must have been taken before."""
    last = [_WRITTEN.pop() for _ in range(keep)]
    gone = _WRITTEN[since:]
    del _WRITTEN[since:]
    _WRITTEN.extend(reversed(last))
    return sum(drop(spark, *x) for x in gone)


def sweep_unread(spark: SparkSession, tables: list[tuple[str, str | None]], reader: DataFrame) -> list[tuple[str, str | None]]:
    """Deletes those of the tables (as in written_since()) that reader doesn't read, and returns the others: all, if reader reads
    anything but files, since what that depends on can't be told."""
    read = folders_of(reader)
    stay = [x for x in tables if read is None or os.path.basename(x[0]) in read]
    for x in tables:
        if x not in stay and x in _WRITTEN:
            _WRITTEN.remove(x)
            drop(spark, *x)
    return stay


def written_since(n: int) -> list[tuple[str, str | None]]:
    """The tables that this process wrote after the first n."""
    return _WRITTEN[n:]


def drop(spark: SparkSession, folder: str, table: str | None) -> bool:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def folders_of(df: DataFrame) -> set[str] | None:
    """Last names of the folders and files that df's plan reads; None if it reads something else. Plans are looked at, not files."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        roots = leaf.relation().location().rootPaths()
        out |= {roots.apply(k).getName() for k in range(roots.size())}
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def seeded_key(seed: str, *cols: Column) -> Column:
    """32 hex digits that order rows as a shuffle by the seed; any SQL engine has the same ones."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]).cast("binary"))


def key_bucket(key: Column, n_buckets: int) -> Column:
    """Which of n_buckets equal ranges of the key's values holds it."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(n_buckets) / F.lit(1 << 32)).cast("long")


def buckets_for(rows: int) -> int:
    """Ranges enough that a task sorts a bounded number of rows, even where one group holds all of them."""
    return max(1024, -(-rows // 65_536))


def running(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: str, before: str, total: str, attach: DataFrame | None = None) -> DataFrame:
    """Adds the sum of value over the rows that precede each row in its group (before) and over the whole group (total).

    Rows of a group are ordered by bucket, then by order. Only rows of one bucket of one group must meet in a task:
    sums by bucket are added up first and joined back by group and bucket, so that a group with a third of all rows
    is spread over as many tasks as it has buckets. groups and bucket must not hold nulls. attach has a row a group, whose
    columns all its rows get; it is joined to the sums, so that a large group need not meet for it either.
    """
    (part,) = fresh(df.columns, "part")
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias(part))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy()
    sums = sums.select(
        *groups,
        bucket,
        (F.sum(part).over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col(part)).alias(before),
        F.sum(part).over(w).alias(total),
    )
    if attach is not None:
        sums = sums.join(attach, groups)
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(sums, [*groups, bucket])
    return out.withColumn(before, F.col(before) + F.sum(value).over(inner) - F.col(value))


#: Row numbers that share a range of ordinals().
ROWS = 1 << 16


def numbered(df: DataFrame, name: str, row: str) -> DataFrame:
    """df with row numbers, written: from here on a row has one number, whatever is computed again."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)


def ordinals(df: DataFrame, same: str, row: str, out: str) -> DataFrame:
    """Numbers the rows that are equal in a key (without nulls) from 0. A key may have a third of all rows: its rows are counted by
    ranges of their row numbers, and a key that one row has, as nearly all do, costs a count alone."""
    many, one, part, total = fresh([*df.columns, out], "many", "one", "part", "total")
    again = written(df.groupBy(same).agg(F.count("*").alias(many)).where(F.col(many) > 1), "repeated")
    if again.isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    found = salted_join(df, again, same, row, "left")
    alone = found.where(F.col(many).isNull()).drop(many).withColumn(out, F.lit(0).cast("long"))
    crowd = found.where(F.col(many).isNotNull()).drop(many).withColumns({one: F.lit(1).cast("long"), part: F.expr(f"`{row}` div {ROWS}")})
    crowd = running(crowd, [same], part, [F.col(row)], one, out, total)
    return alone.unionByName(crowd.select(*alone.columns))


#: Tasks over which the rows of one key are dealt in a salted join.
SALTS = 16


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """many joined with one (a row a key, narrow) by key, where a key may have a third of many's rows: they are dealt out by the
    hash of another column, and one's rows are copied."""
    (salt,) = fresh([*many.columns, *one.columns], "salt")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return many.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(one.withColumn(salt, copies), [key, salt], how).drop(salt)


_STATE: dict = {}


def tidy() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers live on, and else keep the most they ever had."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker_state(key, build=None):
    """What a Python worker keeps from task to task: one thing, that of the operator it works for now. Another operator's is
    dropped, so the memories of a pipeline's stages don't add up. key None: keep nothing."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            tidy()
        if key is not None:
            _STATE[key] = build()
    return _STATE.get(key)
