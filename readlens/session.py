"""What every job needs of a session: the package on the executors, and tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Bounds of a batch that goes to a Python worker, set where the session has Spark's own defaults: long texts would make
#: 10,000 rows a heavy one.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", BATCH_BYTES)}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that Arrow kernels can import it there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="readlens-"), "readlens_package.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(PACKAGE.rglob("*.py")):
                archive.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(path)
        for name, (default, bound) in _BATCH_CONF.items():
            if spark.conf.get(name, default) == default:
                spark.conf.set(name, bound)
        _shipped.add(context.applicationId)
    return spark


def unused(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """Names like these that no column has, in whatever case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and all runs on this machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="readlens-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stages:
    """Tables of one job, written to the shared folder: they cut lineage and outlive executors.

    drop() deletes a table that nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/readlens/{job}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables; frames are as write() gave them."""
        for df in frames:
            self._delete(df.stage_path)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files and broadcasts of frames that nothing holds any more; it waits for the JVM's garbage collector."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._jvm is None:
            return
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM has gone; there is nothing left to delete with
            pass
