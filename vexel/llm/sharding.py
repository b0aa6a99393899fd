"""Operator 2: shards that all match the mixture of sources, by proportional stratified interleaving. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, fresh, key_bucket, numbered, ordinals, running, seeded_key, written

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: str = "shards") -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (gapless from 0 in its shard) to every row.

    Each source's rows are shuffled by the seed and ranked; row r of n has the fractional rank (r + 1/2) / n. All rows
    are sorted by it and cut into shards whose row counts differ by one at most, so that each shard holds every source
    in proportion. Neither step gathers a source or the table in one task: ranks are added up over ranges of the
    seeded key, positions over ranges of the fractional rank.

    The shuffle goes by the seed, the id, the text's checksum and, for rows that are equal in these, their number among
    them: so a third of all rows may have one id, none, or be copies of one row, and still spread over all ranges. The rows
    are written once, with what the steps need; give it narrow ones where the texts aren't wanted.

    Null sources are a source of their own; null texts, empty texts, very long ones (nothing but their checksum counts) and
    repeated rows are rows like others (rows equal in id, source and text may swap places); an empty table gives an empty
    result; with fewer rows than shards, some shards stay empty. Input columns named shard or slot are replaced. Needs
    doc_id, source and text, or text_crc32 in its place.
    """
    docs = docs.drop("shard", "slot")
    row, same, nth, key, bucket, src, none, one, rank, n, part, frac, pos, rows = fresh(docs.columns, "row", "same", "nth", "key", "bucket", "src", "none", "one", "rank", "n", "part", "frac", "pos", "rows")
    crc = F.col("text_crc32") if "text_crc32" in docs.columns else F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    marked = docs.withColumns({src: F.coalesce("source", F.lit("")), none: F.col("source").isNull().cast("int"), one: F.lit(1).cast("long"), same: seeded_key(seed, F.col("doc_id"), crc, F.col("source"))})
    marked = numbered(marked, "shards-rows", row)
    n_buckets = buckets_for(marked.count())
    out = ordinals(marked, same, row, nth).withColumn(key, seeded_key(seed, F.col(same), F.col(nth)))
    out = written(out.withColumn(bucket, key_bucket(F.col(key), n_buckets)).drop(same, nth), "shards-keys")
    order = [F.col(key), F.col(row)]
    out = running(out, [none, src], bucket, order, one, rank, n)
    # (2 r + 1) / 2 n lies in (0, 1): its range, in whole numbers
    out = out.withColumns({frac: (F.col(rank) * 2 + 1) / (F.col(n) * 2).cast("double"), part: F.expr(f"((`{rank}` * 2 + 1) * {n_buckets}) div (`{n}` * 2)")})
    out = running(out, [], part, [F.col(frac), F.col(none), F.col(src), F.col(rank)], one, pos, rows)
    shard = F.expr(f"(`{pos}` * {n_shards}) div `{rows}`")
    first = F.expr(f"(`shard` * `{rows}` + {n_shards - 1}) div {n_shards}")
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col(pos) - first).cast("long"))
    return out.drop(row, key, bucket, src, none, one, rank, n, part, frac, pos, rows)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    # sizes and sums of the texts go on from here: the texts are read once, and in no shuffle
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    out = assign_shards(docs.select("doc_id", "source", size.alias("size"), crc.alias("text_crc32")), n_shards=40)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT b::UBIGINT AS b, b::UBIGINT AS v, 0 AS n FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE n = 8),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS bytes, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT d.* EXCLUDE (h), xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(bytes), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 17)::UBIGINT)),
  lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, crc),
m AS (SELECT *, md5('shards:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || ':' || coalesce(source, 'null')) AS same FROM c),
q AS (SELECT *, md5('shards:' || same || ':' || (row_number() OVER (PARTITION BY same) - 1)) AS key FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM q),
p AS (SELECT *, row_number() OVER (ORDER BY ((2 * rank + 1) * greatest(1024, (total + 65535) // 65536)) // (2 * n), (2 * rank + 1) / (2 * n)::DOUBLE, source IS NULL, encode(source), rank) - 1 AS pos FROM r),
s AS (SELECT *, (pos * 40 // total)::INT AS shard FROM p)
SELECT doc_id, (bytes + 16)::BIGINT AS size, text_crc32, 'rows' AS law, shard, (pos - (shard * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
