"""Upkeep of a corpus: scheduled steps, migration of aged rows, retention of backups, alerts."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import hybrid


class Loop:
    """Runs a step every so many seconds in a thread of its own, until it is stopped. A step that fails is counted and doesn't end the
    loop; two steps never run at once."""

    def __init__(self, step: Callable[[], object], seconds: float):
        if seconds <= 0:
            raise ValueError("an interval is above 0")
        self.step, self.seconds = step, seconds
        self.runs = self.failures = 0
        self.last: object = None
        self.error: Exception | None = None
        self._stop, self._one = threading.Event(), threading.Lock()
        self._thread: threading.Thread | None = None

    def run_once(self) -> None:
        with self._one:
            self.runs += 1
            try:
                self.last, self.error = self.step(), None
            except Exception as e:  # the next run may do better
                self.failures, self.error = self.failures + 1, e

    def start(self, now: bool = False) -> Loop:
        """now: the first step is done before this returns, not when the interval has passed. A loop may be started again."""
        if self._thread is None:
            self._stop.clear()
            if now:
                self.run_once()
            self._thread = threading.Thread(target=self._go, daemon=True)
            self._thread.start()
        return self

    def _go(self) -> None:
        while not self._stop.wait(self.seconds):
            self.run_once()

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None

    def __enter__(self) -> Loop:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()


def migrate_ids(corpus: DataFrame, ids: DataFrame, as_of: datetime | str, threshold: int = hybrid.WEEK) -> DataFrame:
    """What becomes of rows that are asked to be historical: (id, status): migrated, already historical, or not found. Their ts has to
    be moved below the threshold for it to last; see age_out()."""
    tiers = hybrid.with_tier(corpus, as_of, threshold).select("id", "tier")
    found = ids.select("id").distinct().join(tiers, "id", "left")
    return found.select("id", F.when(F.col("tier").isNull(), "not found").when(F.col("tier") == hybrid.RECENT, "migrated").otherwise("already historical").alias("status"))


def age_out(corpus: DataFrame, ids: DataFrame, as_of: datetime | str, threshold: int = hybrid.WEEK) -> DataFrame:
    """The corpus with the ts of these rows at the threshold, where they are younger: from there on they are historical."""
    limit = hybrid.instant(as_of) - F.make_interval(secs=F.lit(threshold))
    marked = ids.select("id").distinct().withColumn("_moved", F.lit(True))
    out = corpus.join(marked, "id", "left").withColumn("ts", F.when(F.col("_moved"), F.least("ts", limit)).otherwise(F.col("ts")))
    return out.select(*corpus.columns)


def orphaned_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files below a saved corpus that its manifest doesn't name the version of: what store.sweep() deletes."""
    m = store.read_manifest(spark, path)
    files = store.BlobStore(spark, path).table("*.parquet").select("path", "length")
    return files.where(~F.col("path").contains(f"/{m['data']}/"))


def retained(backups: DataFrame, keep: int) -> DataFrame:
    """backups (path, ts): which of them a retention of the keep youngest ones leaves; a boolean column, kept."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.orderBy(F.desc("ts"), "path"))
    return backups.withColumn("kept", rank <= keep)


class Alerts:
    """Handlers that are called with a health row whenever its status isn't ok, and once when it is ok again."""

    def __init__(self):
        self.handlers: list[Callable[[dict], object]] = []
        self.status = "ok"

    def on(self, handler: Callable[[dict], object]) -> None:
        self.handlers.append(handler)

    def see(self, health: dict) -> int:
        """Returns how many handlers were called."""
        tell = health["status"] != "ok" or self.status != "ok"
        self.status = health["status"]
        for h in self.handlers if tell else []:
            h(health)
        return len(self.handlers) if tell else 0
