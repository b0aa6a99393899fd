"""Graphs (edge tables) on disk: versions under a manifest, changes of some nodes beside them, and what tells that all is there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import BlobStore, StoreError

#: The one version of the format, and the blob that names the tables.
VERSION, MANIFEST = 1, "graph.json"
COLUMNS = ("layer", "src", "dst", "distance")


def checksum(edges: DataFrame) -> list[int]:
    """Edges and an order-free checksum of them, in one pass."""
    n, h = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*COLUMNS) % (1 << 31)), F.lit(0))).first()
    return [int(n), int(h)]


def _write(edges: DataFrame, path: str, name: str) -> dict:
    """A table, by ranges of nodes, so that a search skips files by their statistics."""
    spark, data = edges.sparkSession, f"{name}-{uuid.uuid4().hex}"
    edges = edges.select(*COLUMNS)
    edges.repartitionByRange("layer", "src").sortWithinPartitions("layer", "src").write.option("compression", "zstd").parquet(f"{path.rstrip('/')}/{data}")
    return {"data": data, "sum": checksum(spark.read.schema(edges.schema).parquet(f"{path.rstrip('/')}/{data}")), "columns": json.loads(edges.schema.json())}


def save(edges: DataFrame, path: str) -> dict:
    """A new version of a graph (layer, src, dst, distance); a graph without layers is one of layer 0. Readers see the old version until
    the manifest is replaced; its tables go then."""
    edges = edges if "layer" in edges.columns else edges.withColumn("layer", F.lit(0))
    blobs = BlobStore(edges.sparkSession, path)
    m = {"version": VERSION, "base": _write(edges, path, "edges"), "changes": []}
    blobs.put(MANIFEST, json.dumps(m).encode())
    for old in {k.split("/")[0] for k in blobs.list() if "/" in k} - {m["base"]["data"]}:
        blobs.delete(old)
    return m


def save_changes(edges: DataFrame, nodes: DataFrame, path: str) -> dict:
    """Adds the edges that some nodes (id) have from now on, in all layers; a node without any loses those it had. What was saved
    before isn't written again."""
    spark = edges.sparkSession
    m, blobs = read_manifest(spark, path), BlobStore(spark, path)
    ids = nodes.select(F.col("id").alias("src")).distinct()
    edges = edges if "layer" in edges.columns else edges.withColumn("layer", F.lit(0))
    part = _write(edges.join(ids, "src", "left_semi"), path, "change")
    part["nodes"] = f"nodes-{uuid.uuid4().hex}"
    ids.write.parquet(f"{path.rstrip('/')}/{part['nodes']}")
    m["changes"].append(part)
    blobs.put(MANIFEST, json.dumps(m).encode())
    return m


def read_manifest(spark: SparkSession, path: str) -> dict:
    text = BlobStore(spark, path).get(MANIFEST)
    if text is None:
        raise StoreError(f"no graph in {path}")
    m = json.loads(text)
    if m.get("version") != VERSION:
        raise StoreError(f"a graph of version {m.get('version')}; {VERSION} is read")
    return m


def _read(spark: SparkSession, path: str, part: dict, verify: bool) -> DataFrame:
    edges = spark.read.schema(T.StructType.fromJson(part["columns"])).parquet(f"{path.rstrip('/')}/{part['data']}")
    if verify and checksum(edges) != part["sum"]:
        raise StoreError(f"the edges of {part['data']} aren't those that were saved")
    return edges


def load(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The edges, with all changes."""
    m = read_manifest(spark, path)
    out = _read(spark, path, m["base"], verify)
    for part in m["changes"]:
        nodes = spark.read.parquet(f"{path.rstrip('/')}/{part['nodes']}")
        out = out.join(nodes, "src", "left_anti").select(*COLUMNS).unionByName(_read(spark, path, part, verify))
    return out.select(*COLUMNS)


def verify(spark: SparkSession, path: str) -> dict:
    """Whether all edges are there as they were saved: {"valid": bool, "errors": [...]}, an error a table."""
    try:
        m = read_manifest(spark, path)
    except StoreError as e:
        return {"valid": False, "errors": [str(e)]}
    errors = []
    for part in [m["base"], *m["changes"]]:
        try:
            _read(spark, path, part, True)
        except StoreError as e:
            errors.append(str(e))
    return {"valid": not errors, "errors": errors}


def merge(spark: SparkSession, path: str) -> dict:
    """Base and changes as one table."""
    return save(load(spark, path), path)


def copy(spark: SparkSession, path: str, to: str) -> dict:
    """A backup of a graph, whose edges are checked on the way; also the way back."""
    return save(load(spark, path, verify=True), to)
