"""Changes to a corpus (id, embedding, metadata, ts): inserts, tombstones, vacuum, updates, schema checks. Tables are values:
each function returns the new one, or what is to be appended."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.filters import VariantField, compile_filter
from ..functions.vectors import valid_vector


def split_insert(existing: DataFrame, batch: DataFrame, dimensions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused with reason): invalid vectors, ids that exist, and all but one row of an id in the batch."""
    order = [F.xxhash64(F.to_json(F.struct("embedding")))]
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    rows = batch.join(known, "id", "left").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.when(valid_vector("embedding", dimensions), 0).otherwise(1), *order)))
    reason = F.when(~valid_vector("embedding", dimensions), "invalid vector").when(F.col("known") | (F.col("n") > 1), "duplicate id")
    rows = rows.withColumn("reason", reason).drop("known", "n")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def insert_into_chunk(existing: DataFrame, batch: DataFrame, chunk: str, dimensions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """split_insert() of rows that all refer to a chunk: what is appended has its name in chunk, by which the table should be partitioned,
    so that a chunk is read alone."""
    rows, refused = split_insert(existing, batch.drop("chunk"), dimensions)
    return rows.withColumn("chunk", F.lit(chunk)), refused


def active(corpus: DataFrame, tombstones: DataFrame) -> DataFrame:
    return corpus.join(tombstones.select("id"), "id", "left_anti")


def delete_ids(corpus: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones to append, ids that don't exist)."""
    ids = ids.select("id").distinct()
    return ids.join(corpus.select("id"), "id", "left_semi"), ids.join(corpus.select("id"), "id", "left_anti")


def delete_where(corpus: DataFrame, f: Any, dialect: str = "full", **options) -> DataFrame:
    """Tombstones of the rows that a metadata filter holds for."""
    return corpus.where(compile_filter(f, dialect=dialect, **options)).select("id")


def vacuum(corpus: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The corpus without deleted rows; their ids may be inserted again."""
    return active(corpus, tombstones)


def update_metadata(corpus: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates (id, metadata, version): the latest of each id replaces the metadata. (new corpus, updates of unknown ids)."""
    last = updates.groupBy("id").agg(F.max_by(F.struct("metadata"), "version").alias("u"))
    out = corpus.join(last, "id", "left").withColumn("metadata", F.when(F.col("u").isNotNull(), F.col("u.metadata")).otherwise(F.col("metadata"))).drop("u")
    return out.select(*corpus.columns), updates.join(corpus.select("id"), "id", "left_anti")


def upsert(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those with the same id."""
    return corpus.join(rows.select("id"), "id", "left_anti").unionByName(rows)


#: Names of the scalar types of a schema, whatever their case, and the VARIANT kinds that they take.
KINDS = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",)}


def parse_schema(schema: dict) -> dict:
    """{"fields": {name: type}, "required": [names]}. A type is "String", "Number" or "Boolean", {"Array": type},
    {"Object": {name: type}}, or the same as {"type": "string"}, {"type": "array", "items": type}, {"type": "object", "fields": {...}}."""

    def of(t: Any):
        if isinstance(t, str) and t.lower() in KINDS:
            return t.lower()
        if isinstance(t, dict):
            kind = str(t.get("type", "")).lower()
            if kind in KINDS:
                return kind
            if kind == "array" or "Array" in t:
                return ("array", of(t["items"] if kind == "array" else t["Array"]))
            if kind == "object" or "Object" in t:
                return ("object", {k: of(v) for k, v in (t["fields"] if kind == "object" else t["Object"]).items()})
        raise ValueError(f"no type: {t!r}")

    return {"fields": {k: of(t) for k, t in schema.get("fields", {}).items()}, "required": list(schema.get("required", []))}


def _errors(name: str, v: VariantField, kind: Any) -> Column:
    """Array of messages for one value that is there; null values are fine."""
    null = F.is_variant_null(v.value) | v.value.isNull()
    have = v.kind()
    wrong = lambda what: F.array(F.concat(F.lit(f"{name}: expected {what}, found "), F.lower(have)))
    none = F.array().cast("array<string>")
    if isinstance(kind, str):
        fits = F.lit(False)
        for k in KINDS[kind]:
            fits = fits | have.startswith(k)
        return F.when(null | fits, none).otherwise(wrong(kind))
    if kind[0] == "array":
        items = F.transform(v.cast("array<variant>"), lambda x, i: F.transform(_errors("", VariantField(x), kind[1]), lambda m: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"), m)))
        return F.when(null, none).when(have.startswith("ARRAY"), F.coalesce(F.flatten(items), none)).otherwise(wrong("array"))
    inner = [_errors(f"{name}.{k}", VariantField(F.try_variant_get(v.value, "$['" + k.replace("'", "\\'") + "']", "variant")), t) for k, t in kind[1].items()]
    return F.when(null, none).when(have.startswith("OBJECT"), F.concat(none, *inner)).otherwise(wrong("object"))


def violations(corpus: DataFrame, schema: dict, metadata: str = "metadata", key: str = "id") -> DataFrame:
    """(id, error): required fields must be there (null will do), known fields must be of their type, others may be anything."""
    s = parse_schema(schema)
    top = VariantField(F.col(metadata))
    is_object = F.coalesce(top.kind().startswith("OBJECT"), F.lit(False))
    at = lambda k: F.try_variant_get(F.col(metadata), "$['" + k.replace("'", "\\'") + "']", "variant")
    none = F.array().cast("array<string>")
    missing = [F.when(at(k).isNull(), F.array(F.lit(f"{k}: required"))).otherwise(none) for k in s["required"]]
    typed = [_errors(k, VariantField(at(k)), t) for k, t in s["fields"].items()]
    errors = F.when(is_object, F.concat(none, *missing, *typed)).otherwise(F.array(F.lit("metadata: expected object")))
    return corpus.select(key, F.explode(errors).alias("error"))
