"""Token files: Parquet list columns, sorted by document, with page indexes.

Rows are range-partitioned and sorted by doc_id, so each file holds a run of
documents. Token ids are one list column, their metadata are small columns
beside it: a reader of counts or places never touches the ids' pages, and a
filter on doc_id skips row groups and, by the column index, pages.

Format: version-2 pages; ids are dictionary-encoded while a dictionary pays,
else delta-encoded; doc_id and the running start are delta-encoded; zstd on
top. Row group and page sizes are parameters.

Places: each task numbers the ids of its own run as it writes (``local_start``);
the runs' totals, one row per file, are summed by prefix when files are read.
The files alone suffice for that.

Defined results: null and empty texts are documents of the end id alone;
repeated rows, also of one doc_id, are written one by one in any order among
themselves; a null doc_id stands before all others; an empty table gives files
without rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.tables import lean, table
from pinweave.llm.tokens import BLOCK_BYTES, encoder, vocabulary_path
from pinweave.storage import new_path, settled

SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode ``docs`` and write them in ascending doc_id order to ``path``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        code = encoder(vocabulary_path(vocabulary), keeps_blanks=False)
        for batch in batches:
            for at, counts, ids in code.blocks(batch.column("text")):
                ends = np.cumsum(counts)
                own = np.insert(ids.astype(np.int32), ends, end_id)
                counts, ends = counts + 1, np.cumsum(counts + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(counts)), pa.array(np.full(len(counts), shard, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists],
                    ["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])
        code.rest()

    rows = lean(docs, BLOCK_BYTES).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # numbers deal out rows without an id, or with one id; the pass that looks for ranges reads no text
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth").drop("nth")
    rows.mapInArrow(encoded, SCHEMA).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#local_start": "false",
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
        }
    ).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of token files with their global places: doc_id, start, n_tokens, ids. Unused columns are never read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row per file, written first, so Spark broadcasts it only where its size is below its own bound
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return files.join(settled(totals, "shards"), "shard").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: one row per document, with a checksum of its ids."""
    path = new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch.column("ids")
            ends, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
