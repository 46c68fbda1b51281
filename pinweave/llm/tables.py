"""What the operators share: reading the tables, and columns that may be missing or null."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


#: Bytes of rows that Spark hands to Python at once, where a session has its own 64 MB: that would be held in the JVM and in Python.
BATCH_BYTES = 4 << 20
_SPARKS_OWN = 64 << 20
_set: set[int] = {_SPARKS_OWN}


def lean(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """``df``, with batches to Python of ``most`` bytes from now on, unless its session names a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(key))) in _set:
        conf.set(key, str(most))
        _set.add(most)
    return df


def give_back() -> None:
    """Hand freed memory back to the system: a task calls it at its end, as Python workers outlive tasks and idle beside others' work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
