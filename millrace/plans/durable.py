"""Intermediate tables that survive the loss of an executor.

A table that several later steps read is written as Parquet below the folder that
the cluster names in ``spark.checkpoint.dir`` and read back. Lineage ends there, and
any executor can read any part of it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark drops a finished query's shuffle files at once where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set here only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(hadoop).delete(at, True)


def materialize(df: DataFrame, tag: str = "table", keep_for: str = "call") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh scan.

    ``keep_for`` groups tables so that ``release`` can drop them once their
    readers are done; whatever is left goes when the interpreter exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/millrace/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the written table replaces what was shuffled for it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _written:
        atexit.register(_at_exit)
    _written.setdefault(keep_for, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep_for: str = "call") -> None:
    """Delete the tables written under ``keep_for``; their readers must be done."""
    for path in _written.pop(keep_for, []):
        _delete(spark, path)


def release_all(spark: SparkSession) -> None:
    """Delete every table written here; no DataFrame made so far may be read any more."""
    for key in list(_written):
        release(spark, key)


def _at_exit() -> None:
    if (spark := SparkSession.getActiveSession()) is not None:
        try:
            release_all(spark)
        except Exception:  # the JVM may already be gone
            return
