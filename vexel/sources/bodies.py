"""Request bodies as a source of rows: a JSON document each, {"id", "vector", "metadata"}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a body, at most.
MOST_BYTES = 10 << 20
FIELDS = "id string, vector array<float>, metadata variant, _bad string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(body): the lines of text files."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def parse(bodies: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): rows as a session takes them (id, embedding, metadata), and the bodies that are none, with the reason. Vectors
    are looked at where rows are inserted. All columns of bodies but body stay with both."""
    size = F.octet_length("body")
    doc = F.from_json(F.when(size <= most_bytes, F.col("body")), FIELDS, {"columnNameOfCorruptRecord": "_bad"})
    reason = F.when(F.length(F.trim(F.coalesce("body", F.lit("")))) == 0, "empty").when(size > most_bytes, "too large").when(F.col("_doc").isNull() | F.col("_doc._bad").isNotNull(), "malformed").when(F.col("_doc.id").isNull(), "no id")
    read = bodies.withColumn("_doc", doc).withColumn("reason", reason)
    others = [c for c in bodies.columns if c != "body"]
    rows = read.where("reason IS NULL").select(*others, "_doc.id", F.col("_doc.vector").alias("embedding"), "_doc.metadata")
    return rows, read.where("reason IS NOT NULL").select(*others, "body", "reason")
