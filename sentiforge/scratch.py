"""Intermediate tables in the folder that driver and executors share.

Every application has one run folder below ``spark.checkpoint.dir``; tables
written there survive lost executors and cut the lineage.  Nothing in it is
needed once the results that read it are stored: ``clear_run_folder`` removes it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sentiforge.session import ensure_checkpoint_dir


def run_folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sentiforge-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the run folder."""
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _open = threading.Lock(), {}


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that begin in here leave no shuffle files when they have ended; the session's own setting comes back
    with the last one (several threads may write)."""
    with _lock:
        count, own = _open.get(spark, (0, None))
        if not count:
            own = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _open[spark] = count + 1, own
    try:
        yield
    finally:
        with _lock:
            count, own = _open.pop(spark)
            if count > 1:
                _open[spark] = count - 1, own
            elif own is None:
                spark.conf.unset(_CLEAN)
            else:
                spark.conf.set(_CLEAN, own)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet and read back; its size in bytes is known to the planner from then on.
    The shuffle files of the query are not needed any more and go at once."""
    path = scratch_path(df.sparkSession, tag)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a ``written`` table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, folder)


def clear_run_folder(spark: SparkSession) -> bool:
    """Delete the run folder with all its tables; call it when no result that reads them is still to be computed."""
    system, path = hadoop_path(spark, run_folder(spark))
    return system.delete(path, True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any path that Spark can write to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str) -> bool:
    """A folder that a Spark writer finished (its commit marker is there)."""
    system, p = hadoop_path(spark, f"{path}/_SUCCESS")
    return system.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    system, p = hadoop_path(spark, path)
    system.delete(p, True)
