"""Gets this package to the Python workers, which the kernels of a plan need."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of a batch that goes to a Python worker, where the session doesn't say otherwise: kernels take a megabyte or two at a time,
#: and what the executor holds of a batch outside its heap is a multiple of it.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT, BATCH_BYTES = "67108864b", "8m"


def on_workers(spark: SparkSession) -> None:
    """Sends the package with the context, once, unless the workers find it by themselves: in their folder or on PYTHONPATH."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    found = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if ROOT in found or getattr(sc, "_vexel_sent", False):
        return
    package = os.path.join(tempfile.mkdtemp(prefix="vexel-"), "vexel.zip")
    with zipfile.ZipFile(package, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "vexel")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
    sc.addPyFile(package)
    sc._vexel_sent = True
