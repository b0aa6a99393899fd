"""A session over one corpus: the calls of a vector database, each of which builds a plan."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import compile_filter
from ..functions.vectors import valid_vector
from ..operators import dml, hybrid, ivf, knn, stats
from ..sources import store

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", T.VariantType()), T.StructField("ts", T.TimestampType())])
#: Rows from which a corpus is clustered.
MIN_TRAINING = 10
#: Clusters that a search reads, and updates of metadata that are kept beside the rows, at most.
N_PROBE, UPDATES = 10, 1000


class SessionError(RuntimeError):
    pass


class VectorSession:
    """as_of: the instant that ages are measured from; None: now, at each call. Rows are appended to a table in the shared folder, so
    the plan of a search doesn't grow with the calls before it; after train() that table is partitioned by cluster, and
    searches read the partitions of the clusters that they probe."""

    def __init__(self, spark: SparkSession, as_of: datetime | None = None, threshold: int = hybrid.WEEK, chunk_rows: int = store.CHUNK_ROWS, session_id: str | None = None):
        if chunk_rows < 1:
            raise SessionError("chunk_rows is 1 at least")
        self.spark, self._as_of, self.threshold, self.chunk_rows = spark, as_of, threshold, chunk_rows
        self.session_id = session_id or uuid.uuid4().hex
        self.folder = store.shared_folder(spark, f"session-{self.session_id}")
        self._corpus: DataFrame | None = spark.createDataFrame([], SCHEMA)
        self._table: str | None = None  # where _corpus is, once rows were added here
        self._dead: list[str] = []
        self._updates: dict[str, str] = {}
        self.tombstones = spark.createDataFrame([], "id string")
        self.centroids: ivf.Centroids | None = None
        self.schema: dict | None = None
        self.dimensions: int | None = None
        self.version = 0

    def __enter__(self) -> VectorSession:
        return self

    def __exit__(self, *_) -> None:
        self.destroy()

    @property
    def corpus(self) -> DataFrame:
        if self._corpus is None:
            raise SessionError("the session is already destroyed")
        if not self._updates:
            return self._corpus
        new = self.spark.createDataFrame([*self._updates.items()], "id string, _new string")
        out = self._corpus.join(F.broadcast(new), "id", "left")
        return out.withColumn("metadata", F.when(F.col("_new").isNotNull(), F.parse_json("_new")).otherwise(F.col("metadata"))).select(*self._corpus.columns)

    @property
    def active(self) -> DataFrame:
        return dml.active(self.corpus, self.tombstones)

    @property
    def as_of(self) -> datetime:
        return self._as_of or datetime.now(timezone.utc).replace(tzinfo=None)

    def _fields(self) -> T.StructType:
        return SCHEMA if self.centroids is None else T.StructType([*SCHEMA.fields, T.StructField("cluster_id", T.IntegerType())])

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        self._append(rows, path)
        return path

    def _append(self, rows: DataFrame, path: str) -> None:
        names = [f.name for f in SCHEMA]
        if self.centroids is None:
            rows.select(*names).write.mode("append").parquet(path)
        else:
            ivf.assign(rows.select(*names), self.centroids).select(*names, "cluster_id").write.mode("append").partitionBy("cluster_id").parquet(path)

    def _replace(self, rows: DataFrame) -> None:
        """Writes a new table of these rows, by the present centroids."""
        self._table = self._write(rows, "rows")
        self._corpus, self._updates = self.spark.read.schema(self._fields()).parquet(self._table), {}

    def set_schema(self, schema: dict | str | None) -> None:
        schema = json.loads(schema) if isinstance(schema, str) else schema
        if schema is not None:
            dml.parse_schema(schema)
        self.schema = schema

    def _rows(self, rows: list[dict] | DataFrame) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows.select(*[F.col(f.name).cast(f.dataType) if f.name != "metadata" else F.col("metadata") for f in SCHEMA])
        data = [(r["id"], [float(x) for x in r["vector"]], json.dumps(r.get("metadata", {})), str(r.get("ts", self.as_of))) for r in rows]
        df = self.spark.createDataFrame(data, "id string, embedding array<float>, metadata string, ts string")
        return df.withColumns({"metadata": F.parse_json("metadata"), "ts": F.col("ts").cast("timestamp")})

    def add(self, rows: list[dict] | DataFrame) -> dict:
        """Appends the good rows: {"added": n, "failed": [(id, reason)] (the first 1000), "n_failed": n, "failures": all of them as a
        table (id, reason)}."""
        batch = self._rows(rows)
        if self.dimensions is None:
            first = batch.where(valid_vector("embedding")).select(F.size("embedding")).first()
            self.dimensions = first[0] if first else None
        good, bad = dml.split_insert(self.corpus, batch, self.dimensions)
        failed = bad.select("id", "reason")
        if self.schema is not None:
            errors = dml.violations(good, self.schema).groupBy("id").agg(F.min("error").alias("reason"))
            good, failed = good.join(errors, "id", "left_anti"), failed.unionByName(errors)
        # both are written before the table changes that they were told from
        named = f"{self.folder}/failed-{uuid.uuid4().hex}"
        failed.write.parquet(named)
        failures = self.spark.read.schema("id string, reason string").parquet(named)
        fresh = f"{self.folder}/batch-{uuid.uuid4().hex}"
        good.select(*[f.name for f in SCHEMA]).write.parquet(fresh)
        new = self.spark.read.schema(SCHEMA).parquet(fresh)
        if self._table is None:
            self._replace(self._corpus.select(*[f.name for f in SCHEMA]))
        self._append(new, self._table)
        self._corpus = self.spark.read.schema(self._fields()).parquet(self._table)
        self.version += 1
        return {"added": new.count(), "failed": [(r.id, r.reason) for r in failures.orderBy("id").limit(1000).collect()], "n_failed": failures.count(), "failures": failures}

    def _probed(self, rows: DataFrame, q: list[float], n_probe: int | None) -> DataFrame:
        """The rows of the n_probe nearest clusters (constants of the plan, so other partitions are not read); all, where rows aren't
        clustered or n_probe is 0."""
        if self.centroids is None or n_probe == 0:
            return rows
        return rows.where(F.col("cluster_id").isin(self.centroids.nearest(q, N_PROBE if n_probe is None else n_probe)))

    def search(self, q: list[float], k: int = 10, filter: Any = None, threshold: float = 0.0, include_vectors: bool = False, include_metadata: bool = True, mode: str = "pre", dialect: str = "full", n_probe: int | None = None) -> DataFrame:  # noqa: A002
        """n_probe: clusters to read, once the session is trained (None: N_PROBE); 0: all rows, exactly."""
        if self.dimensions is not None and len(q) != self.dimensions:
            raise SessionError(f"the query has {len(q)} dimensions, the corpus {self.dimensions}")
        where = None if filter is None else compile_filter(filter, dialect=dialect)
        rows = self._probed(self.active, q, n_probe)
        if where is not None and mode == "post":
            out = hybrid.search_filtered(rows, q, k, where, "post")
        else:
            out = hybrid.search(rows, q, k, self.as_of, self.threshold, where=where)
        out = out.where(F.col("score") >= threshold)
        keep = ["id", "distance", "score", *(["metadata"] if include_metadata else []), *(["embedding"] if include_vectors else [])]
        return out.select(*keep).orderBy("distance", "id")

    def search_batch(self, queries: dict[str, list[float]] | DataFrame, k: int = 10, n_probe: int | None = None) -> DataFrame:
        """(query_id, rank, id, distance, score) for every query, by id or as a table (query_id, q)."""
        if not isinstance(queries, DataFrame):
            queries = self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in queries.items()], "query_id string, q array<double>")
        if self.centroids is None or n_probe == 0:
            return knn.nearest_batch(self.active, queries, k)
        return ivf.search_batch(self.active, self.centroids, queries, k, N_PROBE if n_probe is None else n_probe)

    def get(self, id_: str) -> Any:
        return self.active.where(F.col("id") == id_).first()

    def delete(self, id_: str) -> None:
        if self.get(id_) is None:
            raise SessionError(f"no vector {id_}")
        self._bury(self.spark.createDataFrame([(id_,)], "id string"))

    def _bury(self, ids: DataFrame) -> DataFrame:
        """Writes ids to the table of tombstones; returns them."""
        path = f"{self.folder}/dead-{uuid.uuid4().hex}"
        ids.select("id").distinct().write.parquet(path)
        before = [] if self._dead else [self.tombstones]
        self._dead.append(path)
        if before and not self.tombstones.isEmpty():
            first = f"{self.folder}/dead-{uuid.uuid4().hex}"
            self.tombstones.select("id").write.parquet(first)
            self._dead.append(first)
        self.tombstones = self.spark.read.schema("id string").parquet(*self._dead).distinct()
        self.version += 1
        return self.spark.read.schema("id string").parquet(path)

    def delete_by_metadata(self, filter: Any, dialect: str = "full") -> dict:  # noqa: A002
        """{"count": n, "ids": the first 10,000, "deleted": all of them as a table (id)}."""
        gone = self._bury(dml.delete_where(self.active, filter, dialect))
        return {"count": gone.count(), "ids": [r.id for r in gone.orderBy("id").limit(10_000).collect()], "deleted": gone}

    def deleted(self) -> DataFrame:
        """Ids of rows that are deleted and not yet vacuumed."""
        return self.corpus.select("id").join(self.tombstones, "id", "left_semi")

    def update_metadata(self, id_: str, metadata: dict) -> None:
        """Kept beside the rows until there are UPDATES of them, and then written into them."""
        if self.get(id_) is None:
            raise SessionError(f"no vector {id_}")
        if self.schema is not None:
            new = self.spark.createDataFrame([(id_, json.dumps(metadata))], "id string, metadata string").withColumn("metadata", F.parse_json("metadata"))
            errors = dml.violations(new, self.schema).collect()
            if errors:
                raise SessionError("; ".join(sorted(r.error for r in errors)))
        self._updates = {**self._updates, id_: json.dumps(metadata)}
        if len(self._updates) >= UPDATES:
            self._replace(self.corpus)
        self.version += 1

    def vacuum(self) -> int:
        n = self.deleted().count()
        self._replace(dml.vacuum(self.corpus, self.tombstones))
        self.tombstones, self._dead = self.spark.createDataFrame([], "id string"), []
        return n

    def stats(self) -> dict:
        return stats.session_stats(self.corpus, self.tombstones, self.as_of, self.threshold).first().asDict()

    def train(self, n_clusters: int, **options) -> ivf.Centroids | None:
        """Clusters the corpus: searches then read the clusters that they probe. None for a corpus too small for it, which is
        scanned whole."""
        rows = self.active
        if rows.limit(MIN_TRAINING).count() < MIN_TRAINING:
            return None
        centroids, corpus = ivf.train(rows, n_clusters, **options), self.corpus
        self.centroids = centroids
        self._replace(corpus)
        self.version += 1
        return centroids

    def find_similar(self, id_: str, k: int) -> DataFrame:
        return knn.find_similar(self.active, id_, k)

    def save(self, path: str) -> dict:
        """Rows (by cluster, once there are any), tombstones, centroids and schema as a new version under path."""
        centroids = None if self.centroids is None else self.centroids.table(self.spark)
        by = None if self.centroids is None else ["cluster_id"]
        return store.save(self.corpus, path, self.tombstones, centroids, schema=self.schema, chunk_rows=self.chunk_rows, partition_by=by)

    @classmethod
    def load(cls, spark: SparkSession, path: str, verify: bool = False, **options) -> VectorSession:
        """Reads no rows but one: those of a search come from the files, by cluster where it was saved so."""
        found = store.load(spark, path, verify=verify)
        out = cls(spark, **options)
        out._corpus, out.schema = found["corpus"], found["schema"]
        if found["tombstones"] is not None:
            out.tombstones = found["tombstones"]
        if found["centroids"] is not None:
            out.centroids = ivf.Centroids.from_table(found["centroids"])
        first = out.corpus.select(F.size("embedding")).first()
        out.dimensions = first[0] if first else None
        return out

    def destroy(self) -> None:
        self.corpus  # noqa: B018  raises if it is destroyed already
        self._corpus = None


class SearchCache:
    """Results of searches, collected, by query, options and version of the corpus; the one not used longest goes first."""

    def __init__(self, capacity: int = 100):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self.entries: OrderedDict[tuple, list] = OrderedDict()

    def search(self, session: VectorSession, q: list[float], k: int = 10, **options) -> list:
        key = (tuple(float(x) for x in q), k, json.dumps(options, sort_keys=True, default=str), session.version)
        if key in self.entries:
            self.hits += 1
            self.entries.move_to_end(key)
            return self.entries[key]
        self.misses += 1
        rows = self.entries[key] = session.search(q, k, **options).collect()
        while len(self.entries) > self.capacity:
            self.entries.popitem(last=False)
        return rows

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.entries), "hit_rate": self.hits / n if n else 0.0}
