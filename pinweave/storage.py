"""Shared-folder tables: the one way this library cuts lineage.

A table written here survives the loss of any executor, because it lies in the
folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"

#: Where each settled table lies, and every path that was written and not deleted.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master gets a fresh one."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="pinweave-")
    spark.conf.set(_KEY, own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/pinweave-{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """Such a path for other files than settled tables, which ``sweep`` deletes as well."""
    path = new_path(spark, name)
    _written.add(path)
    return path


def settled(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage but the files. Column order and types stay;
    every column becomes nullable.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
    _written.discard(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    if path := _paths.pop(table, None):
        _delete(table.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that this process has settled: for the end of a job, when its results are written."""
    for path in list(_written):
        _delete(spark, path)
