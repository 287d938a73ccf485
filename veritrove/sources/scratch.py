"""Intermediate tables in the folder that all executors share.

Iterative and two-pass operators cut their lineage by writing a table and reading it again.  The
folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests on
one machine) a temporary one is made.  A lost executor loses nothing of what was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a temporary folder on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (master := spark.sparkContext.master) == "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _LOCAL[app]


class Scratch:
    """Tables written by one run of an operator; ``drop`` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and give the table read back, and its path."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        """Remove a superseded table."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
