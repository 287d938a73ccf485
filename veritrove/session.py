"""A session with the settings the engine is tested with."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g", shared: str | None = None) -> SparkSession:
    """A local session: adaptive planning and Arrow on, UTC, as many shuffle partitions as asked for.

    ``shared`` is the folder for intermediate tables (``spark.checkpoint.dir``); by default one of this process, removed at its end.
    """
    if shared is None:
        made = tempfile.mkdtemp(prefix="veritrove-")
        atexit.register(shutil.rmtree, made, True)
        shared = f"file://{made}"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veritrove")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
