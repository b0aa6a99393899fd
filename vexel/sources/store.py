"""Persistence: corpora as partitioned Parquet under a manifest, and blobs; everything through Hadoop file systems."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import zlib
import uuid
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import running_sum

#: Version that is written; those up to it are read.
VERSION = 3
CHUNK_ROWS = 10_000


class StoreError(ValueError):
    pass


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the session names for all executors (spark.checkpoint.dir). Only where driver and executors are
    one machine may it be unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vexel-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class BlobStore:
    """Bytes by path below a root, which any Hadoop file system may hold."""

    def __init__(self, spark: SparkSession, root: str):
        if not root:
            raise StoreError("an empty path")
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def put(self, key: str, data: bytes) -> None:
        """Written beside and renamed over the old one, so that readers see either of them whole."""
        part = self._path(f"{key}.{uuid.uuid4().hex}.part")
        out = self.fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        self._rename(part, self._path(key))

    def _rename(self, part, target) -> None:
        kinds = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self.fs.makeQualified(part), self.fs.makeQualified(target), kinds)

    def get(self, key: str) -> bytes | None:
        if not self.exists(key):
            return None
        stream = self.fs.open(self._path(key))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        return bool(self.fs.exists(self._path(key)))

    def delete(self, key: str) -> bool:
        return bool(self.fs.delete(self._path(key), True))

    def list(self, prefix: str = "") -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        found, files = [], self.fs.listFiles(self._path(""), True)
        base = self.fs.resolvePath(self._path("")).toString().rstrip("/") + "/"
        while files.hasNext():
            name = files.next().getPath().toString()
            key = name[len(base) :] if name.startswith(base) else name
            if key.startswith(prefix) and not key.rsplit("/", 1)[-1].startswith("."):
                found.append(key)
        return sorted(found)

    def table(self, glob: str = "*") -> DataFrame:
        """All blobs as (path, modificationTime, length, content), for distributed reads."""
        return self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(self.root)


class CachedStore:
    """A store with the last blobs read in memory: at most so many, so many bytes, and not older than ttl seconds."""

    def __init__(self, inner, capacity: int = 100, ttl: float | None = None, max_bytes: int | None = None, clock=time.monotonic):
        self.inner, self.capacity, self.ttl, self.max_bytes, self.clock = inner, capacity, ttl, max_bytes, clock
        self.entries: OrderedDict[str, tuple[float, bytes]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> bytes | None:
        if key in self.entries and (self.ttl is None or self.clock() - self.entries[key][0] < self.ttl):
            self.hits += 1
            self.entries.move_to_end(key)
            return self.entries[key][1]
        self.misses += 1
        self.entries.pop(key, None)
        data = self.inner.get(key)
        if data is not None:
            self._keep(key, data)
        return data

    def _keep(self, key: str, data: bytes) -> None:
        self.entries[key] = (self.clock(), data)
        self.entries.move_to_end(key)
        while len(self.entries) > self.capacity or (self.max_bytes is not None and self.bytes() > self.max_bytes and self.entries):
            self.entries.popitem(last=False)

    def put(self, key: str, data: bytes) -> None:
        self.inner.put(key, data)
        self._keep(key, data)

    def delete(self, key: str) -> bool:
        self.entries.pop(key, None)
        return self.inner.delete(key)

    def list(self, prefix: str = "") -> list[str]:
        return self.inner.list(prefix)

    def bytes(self) -> int:
        return sum(len(x) for _, x in self.entries.values())

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.entries), "bytes": self.bytes(), "hit_rate": self.hits / asked if asked else 0.0}


class ContentStore:
    """Blobs by the hash of what they hold, with keys that point to them; put() is idempotent. Blobs may be compressed: what is
    hashed is what they hold either way."""

    def __init__(self, inner):
        self.inner = inner

    def put(self, key: str, data: bytes, compress: bool = False) -> str:
        cid = hashlib.sha256(data).hexdigest()
        if self.inner.get(f"blobs/{cid}") is None:
            self.inner.put(f"blobs/{cid}", b"z" + zlib.compress(data) if compress else b"r" + data)
        self.inner.put(f"keys/{key}", cid.encode())
        return cid

    def get(self, key: str) -> bytes | None:
        cid = self.inner.get(f"keys/{key}")
        return None if cid is None else self.get_by_cid(cid.decode())

    def get_by_cid(self, cid: str) -> bytes | None:
        data = self.inner.get(f"blobs/{cid}")
        if data is None:
            return None
        out = zlib.decompress(data[1:]) if data[:1] == b"z" else data[1:]
        if hashlib.sha256(out).hexdigest() != cid:
            raise StoreError(f"blob {cid} doesn't hold what it should")
        return out

    def put_batch(self, items: dict[str, bytes], compress: bool = False) -> dict[str, str | Exception]:
        """The content id of each item, or the error that it met; the others are written all the same."""
        return {k: _tried(self.put, k, v, compress) for k, v in items.items()}

    def get_batch(self, keys: list[str]) -> dict[str, bytes | None | Exception]:
        return {k: _tried(self.get, k) for k in keys}


def _tried(fn, *args):
    try:
        return fn(*args)
    except Exception as e:  # one item's error is its result
        return e


def number_chunks(corpus: DataFrame, order: str = "id", rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """Adds row (from 0, in the order) and chunk (row div rows). Ranges of the order are counted first, so no task has them all."""
    numbered = running_sum(corpus.withColumn("_one", F.lit(1).cast("long")), order, "_one", "row", "_all", buckets)
    return numbered.withColumn("row", F.col("row") - 1).withColumn("chunk", F.floor(F.col("row") / rows).cast("long")).drop("_one", "_all")


def overlaps(first_a: Column, last_a: Column, first_b: Column, last_b: Column) -> Column:
    """Whether two ranges, ends included, have a place in common."""
    return (first_a <= last_b) & (first_b <= last_a)


def overlapping(ranges: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, other): pairs of ranges (whole numbers) with a place in common, each once, the smaller key first. Ranges meet at the places
    that they cover, so nothing is compared with what it has no place in common with."""
    at = ranges.select(F.col(key).alias("x"), F.explode(F.sequence(F.col(first), F.col(last))).alias("at"))
    pairs = at.join(at.select(F.col("x").alias("y"), "at"), "at").where("x < y").select("x", "y").distinct()
    return pairs.select(F.col("x").alias(key), F.col("y").alias("other"))


def validate_manifest(text: str) -> dict:
    try:
        m = json.loads(text)
    except ValueError as e:
        raise StoreError(f"manifest: {e}") from e
    if not isinstance(m, dict):
        raise StoreError("manifest: not an object")
    for k in ("version", "chunk_size", "total_vectors", "chunks"):
        if k not in m:
            raise StoreError(f"manifest: no {k}")
    if m["version"] > VERSION:
        raise StoreError(f"manifest: version {m['version']} is newer than {VERSION}")
    ids = [c["chunk_id"] for c in m["chunks"]]
    if len(ids) != len(set(ids)):
        raise StoreError("manifest: a chunk twice")
    return m


def content_hash(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free checksum of ids and vectors, in one pass."""
    n, h = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("id", "embedding") % (1 << 31)), F.lit(0))).first()
    return int(n), int(h)


def save(corpus: DataFrame, path: str, tombstones: DataFrame | None = None, centroids: DataFrame | None = None, schema: dict | None = None, chunk_rows: int = CHUNK_ROWS, partition_by: list[str] | None = None, single: bool = False) -> dict:
    """Writes a new version of the corpus and then the manifest that names it: until then readers see the old one.

    partition_by: columns such as cluster_id, whose values a search then reads alone. Files have chunk_rows rows at most. single: one
    file of all rows, written by one task, for a corpus that is small enough for it."""
    if chunk_rows < 1:
        raise StoreError("chunk_rows is 1 at least")
    spark, store, version = corpus.sparkSession, BlobStore(corpus.sparkSession, path), uuid.uuid4().hex
    base = f"{path.rstrip('/')}/data-{version}"
    writer = (corpus.coalesce(1).write if single else corpus.write.option("maxRecordsPerFile", chunk_rows)).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{base}/vectors")
    if tombstones is not None:
        tombstones.select("id").distinct().write.parquet(f"{base}/tombstones")
    if centroids is not None:
        centroids.write.parquet(f"{base}/centroids")
    n, h = content_hash(spark.read.schema(corpus.schema).parquet(f"{base}/vectors"))
    files = [k for k in store.list(f"data-{version}/vectors") if k.endswith(".parquet")]
    manifest = {"version": VERSION, "chunk_size": chunk_rows, "total_vectors": n, "checksum": h, "data": f"data-{version}", "columns": json.loads(corpus.schema.json()), "tombstones": tombstones is not None, "centroids": centroids is not None, "schema": schema, "chunks": [{"chunk_id": f} for f in files]}
    n = max([0, *map(manifest_number, manifests(store))]) + 1
    store.put(f"manifest-{n:08d}.json", json.dumps(manifest).encode())
    for old in manifests(store):
        if manifest_number(old) < n:
            store.delete(old)
    return manifest


def manifest_number(key: str) -> int:
    return int(key[len("manifest-") : -len(".json")])


def manifests(store: BlobStore) -> list[str]:
    """Manifests in a folder, the newest last. Each save writes a new one before older ones go, so one is always there."""
    return sorted((k for k in store.list("manifest-") if k.endswith(".json")), key=manifest_number)


def read_manifest(spark: SparkSession, path: str) -> dict:
    store = BlobStore(spark, path)
    for key in reversed(manifests(store)):
        text = store.get(key)
        if text is not None:
            return validate_manifest(text.decode())
    raise StoreError(f"no manifest in {path}")


def info(spark: SparkSession, path: str) -> dict:
    """What a saved corpus, or a backup, says of itself, without reading rows."""
    m = read_manifest(spark, path)
    blobs = BlobStore(spark, path).table("*.parquet").select("path", "length").where(F.col("path").contains(m["data"]))
    size = blobs.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return {"version": m["version"], "rows": m["total_vectors"], "chunks": len(m["chunks"]), "files": size.files, "bytes": size.bytes, "tombstones": m["tombstones"], "centroids": m["centroids"]}


def verify(spark: SparkSession, path: str) -> dict:
    """Whether a saved corpus, or a backup, holds the rows that were saved: {"valid": bool, "errors": [...]}."""
    try:
        m = read_manifest(spark, path)
    except StoreError as e:
        return {"valid": False, "errors": [str(e)]}
    there, errors = set(BlobStore(spark, path).list(m["data"])), []
    gone = [c["chunk_id"] for c in m["chunks"] if c["chunk_id"] not in there]
    errors += [f"no file {x}" for x in gone]
    if not gone:
        try:
            load(spark, path, verify=True)["corpus"].limit(0).count()
        except StoreError as e:
            errors.append(str(e))
    return {"valid": not errors, "errors": errors}


def load(spark: SparkSession, path: str, verify: bool = False) -> dict:
    """corpus, tombstones and centroids (None if there are none), schema and manifest."""
    from pyspark.sql import types as T

    m = read_manifest(spark, path)
    base = f"{path.rstrip('/')}/{m['data']}"
    corpus = spark.read.schema(T.StructType.fromJson(m["columns"])).parquet(f"{base}/vectors")
    if verify and content_hash(corpus) != (m["total_vectors"], m["checksum"]):
        raise StoreError("the rows aren't those that were saved")
    read = lambda name: spark.read.parquet(f"{base}/{name}") if m[name] else None
    return {"corpus": corpus, "tombstones": read("tombstones"), "centroids": read("centroids"), "schema": m["schema"], "manifest": m}


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Deletes the versions that the manifest doesn't name; returns them."""
    store = BlobStore(spark, path)
    m = read_manifest(spark, path)
    old = sorted({k.split("/")[0] for k in store.list("data-")} - {m["data"]})
    for k in old:
        store.delete(k)
    return old


def increment(corpus: DataFrame, since) -> DataFrame:
    """What an incremental backup holds: rows younger than the last one."""
    return corpus.where(F.col("ts") > F.lit(str(since)).cast("timestamp"))


def restore(full: DataFrame, increments: list[DataFrame], until=None) -> DataFrame:
    """The full backup and its increments, the latest row of each id, up to an instant."""
    rows = full.withColumn("_at", F.lit(0))
    for i, x in enumerate(increments):
        rows = rows.unionByName(x.withColumn("_at", F.lit(i + 1)))
    if until is not None:
        rows = rows.where(F.col("ts") <= F.lit(str(until)).cast("timestamp"))
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("_at"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def compact(spark: SparkSession, path: str, chunk_rows: int = CHUNK_ROWS, partition_by: list[str] | None = None) -> dict:
    """Rewrites a corpus without its deleted rows, in files of chunk_rows rows, as a new version."""
    old = load(spark, path)
    rows = old["corpus"] if old["tombstones"] is None else old["corpus"].join(old["tombstones"].select("id"), "id", "left_anti").select(*old["corpus"].columns)
    files = max(1, -(-old["manifest"]["total_vectors"] // chunk_rows))
    rows = rows.repartition(files, *partition_by) if partition_by else rows.repartition(files)
    return save(rows, path, centroids=old["centroids"], schema=old["schema"], chunk_rows=chunk_rows, partition_by=partition_by)
