"""Numbered lines of text files, and dense ids, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.storage import settled

_NTH = (1 << 33) - 1  # monotonically_increasing_id holds the partition above these bits, the row in it below


def numbered_lines(spark: SparkSession, path: str, comment: str | None = "%") -> DataFrame:
    """(n, value): lines with a number from 0, in file order; empty and comment lines are left out.

    Rows are numbered inside their file split, and splits by a prefix sum.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    kept = raw.where(F.trim("value") != "")
    if comment:
        kept = kept.where(~F.ltrim("value").startswith(comment))
    own = settled(kept.select("value", "f", "b", (F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1).alias("i")), "lines")
    sizes = own.groupBy("f", "b").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per split
    return own.join(sizes.select("f", "b", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("i")).alias("n"), "value")


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, n): distinct ids with numbers from 0 in ascending order."""
    sorted_ids = ids.toDF("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    own = settled(sorted_ids.select("id", F.monotonically_increasing_id().alias("m")), "ids").select("id", F.shiftright("m", 33).alias("shard"), F.col("m").bitwiseAND(F.lit(_NTH)).alias("i"))
    sizes = own.groupBy("shard").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per task
    return own.join(sizes.select("shard", before.alias("before")), "shard").select("id", (F.col("before") + F.col("i")).alias("n"))
