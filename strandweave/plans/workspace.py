"""Scratch tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table and reading it back.  The
folder is the one the session names in ``spark.checkpoint.dir``; a default is chosen
only when that setting is absent (single-machine tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI, from the session's settings."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = DEFAULT_ROOT
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """One operator call's folder below the shared root."""

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a plain scan of what was written.

        The scan carries no partitioning of the plan before it, so a later join has an
        exchange on each side and AQE may split its skewed partitions.
        """
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads.

        The driver's garbage is collected too, as the shuffle files of finished plans go
        only when nothing there refers to them.
        """
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = getattr(df, "_workspace_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        jvm.System.gc()
