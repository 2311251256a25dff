"""Reading tables and cutting lineage, the same way everywhere."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a directory of part files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    The setting is read from the session. Only where it is unset and the master
    is a single process (as in tests) a temporary folder takes its place; on a
    cluster a missing setting is an error, since a machine's own disk would not
    survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "folio-checkpoints")
    return folder.rstrip("/")


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is removed when the driver ends."""

    def remove() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may already have ended
            pass

    atexit.register(remove)
    return path
