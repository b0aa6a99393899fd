"""Clusters of a saved corpus, read when a search first probes them and kept for the next one."""

from __future__ import annotations

import threading
from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ivf, knn
from . import store


class ClusterCache:
    """At most so many clusters stay cached on the executors, the one not probed longest goes first. Threads that ask for a cluster at
    the same time share one read of it."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = 100):
        found = store.load(spark, path)
        if found["centroids"] is None:
            raise store.StoreError("a corpus without centroids")
        self.centroids = ivf.Centroids.from_table(found["centroids"])
        dead, rows = found["tombstones"], found["corpus"]
        self.rows = rows if dead is None else rows.join(dead.select("id"), "id", "left_anti").select(*rows.columns)
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self.clusters: OrderedDict[int, DataFrame] = OrderedDict()
        self._lock = threading.Lock()

    def read(self, cluster: int) -> DataFrame:
        with self._lock:
            if cluster in self.clusters:
                self.hits += 1
                self.clusters.move_to_end(cluster)
                return self.clusters[cluster]
            self.misses += 1
            # the plan is entered before it is run, so others wait for its blocks, not for another read
            df = self.clusters[cluster] = self.rows.where(F.col("cluster_id") == cluster).persist(StorageLevel.MEMORY_AND_DISK)
            while len(self.clusters) > self.capacity:
                self.clusters.popitem(last=False)[1].unpersist()
            return df

    def search(self, q: list[float], k: int, n_probe: int = 10) -> DataFrame:
        parts = [self.read(c) for c in self.centroids.nearest(q, n_probe)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return knn.nearest(rows, q, k, self.centroids.metric)

    def clear(self) -> None:
        with self._lock:
            for df in self.clusters.values():
                df.unpersist()
            self.clusters.clear()

    def stats(self) -> dict:
        n = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.clusters), "hit_rate": self.hits / n if n else 0.0}
