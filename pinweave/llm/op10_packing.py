"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

Each document is cut into full sequences and one remainder. The remainders'
histogram has at most ``size`` bins whatever the number of documents, so the
plan is made on it alone: lengths go longest first, each to the shortest pack
that has room, and packs of equal content are one pattern with a count.
Patterns then go back to the pieces by their rank among pieces of that length.
Where that leaves more than ``MOST_PADDING``, as a hot length that divides badly
into ``size`` does, the packs below that fill are laid end to end instead and
their pieces cut at the ends of sequences, each once at most.

Ranks need no sort of all pieces: each task numbers its own pieces of a length
as it writes them, and a prefix sum over (task, length) counts, a small table
that is never collected, makes the numbers global. A hot length (a third of
all documents being copies, say) is therefore counted in all tasks alike.

Defined results: null and empty texts are documents of the end id alone;
repeated rows, also of one doc_id, are packed one by one; a null doc_id stays
null; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.tables import BATCH_BYTES, give_back, lean, table
from pinweave.llm.tokens import encoder, vocabulary_path
from pinweave.storage import settled

_PIECES = "doc_id long, start long, length int, doc_tokens long, ids binary, shard int, nth long"
#: Pieces handed to Spark at once, by bytes of ids.
_OUT_BYTES = 4 << 20
#: Offsets, one row per task and length, go to all executors up to this many rows (24 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 1 << 18
#: Remainders are cut again only if packing them whole leaves a larger share of the sequences empty.
MOST_PADDING = 0.01


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths, longest first; how many such packs), by shortest pack first.

    ``histogram`` maps a length from 1 to ``size`` to its number of pieces.
    The work depends on the number of lengths, not of pieces.
    """
    by_total: dict[int, Counter] = {}
    open_totals: list[int] = []

    def put(pack: tuple[int, ...], n: int) -> None:
        total = sum(pack)
        if total not in by_total:
            by_total[total] = Counter()
            heapq.heappush(open_totals, total)
        by_total[total][pack] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while open_totals and not by_total[open_totals[0]]:
                del by_total[heapq.heappop(open_totals)]
            shortest = open_totals[0] if open_totals else size
            if shortest + length > size:  # as one by one: a new pack is the shortest until it has no room
                each = size // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            pack = min(by_total[shortest])
            n = min(left, by_total[shortest][pack])
            by_total[shortest][pack] -= n
            if not by_total[shortest][pack]:
                del by_total[shortest][pack]
            put((*pack, length), n)
            left -= n
    return sorted((pack, n) for packs in by_total.values() for pack, n in packs.items())


def slots(plan: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each slot, its position among all sequences' ids, and the ids from one such pack to the next.

    Packs are ``size`` apart, or end to end after all others where they are laid so.
    """
    used, packs = sum(sum(pack) * n for pack, n in plan), sum(n for _, n in plan)
    least = size * (1 - MOST_PADDING) if used < packs * size * (1 - MOST_PADDING) else 0
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: Counter = Counter()
    position = 0
    for pack, n in sorted(plan, key=lambda x: sum(x[0]) < least):
        step = size if sum(pack) >= least else sum(pack)
        at = position
        for length in pack:
            rows.setdefault(length, []).append((rank[length], at, step))
            rank[length] += n
            at += length
        position += n * step
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def cut_texts(batches: Iterator[pa.RecordBatch], shard: int, vocabulary: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's documents; what a block of texts took is given back before the next, as other tasks share the memory."""
    seen = Counter()
    code = encoder(vocabulary_path(vocabulary), keeps_blanks=True)
    out: list[tuple] = []
    held = 0

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in _PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        doc_ids = batch.column("doc_id")
        for at, counts, ids in code.blocks(batch.column("text"), BATCH_BYTES):
            ends = np.cumsum(counts)
            for i, (n, to) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                own = np.append(ids[to - n : to], ids.dtype.type(end_id)).astype("<u4").tobytes()
                doc_id = doc_ids[at + i].as_py()
                for start in range(0, n + 1, size):
                    length = min(size, n + 1 - start)
                    out.append((doc_id, start, length, n + 1, own[4 * start : 4 * (start + length)], shard, seen[length]))
                    seen[length] += 1
                    held += 4 * length
                if held >= _OUT_BYTES:
                    yield rows(out)
                    out, held = [], 0
            give_back()
    code.rest()
    if out:
        yield rows(out)


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Every document's ids, cut at multiples of ``size``, with each piece's number among its task's pieces of that length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_texts(batches, TaskContext.get().partitionId(), vocabulary, end_id, size)

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, _PIECES)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, size: int = 1024) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit integers. A sequence holds at
    most ``size`` ids, gapless from offset 0.
    """
    cut = settled(pieces(docs, vocabulary, end_id, size), "pieces", compression="zstd")
    counts = settled(cut.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    place = slots(patterns(histogram, size), size)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "length", F.coalesce(before, F.lit(0)).alias("before"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            position = np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                first, at, step = place[int(lengths[own[0]])]
                k = np.searchsorted(first, ranks[own], side="right") - 1
                position[own] = at[k] + (ranks[own] - first[k]) * step[k]
            yield rows(batch, np.arange(len(lengths)), np.zeros(len(lengths), np.int64), np.minimum(lengths, size - position % size), position)
            over = np.flatnonzero(position % size + lengths > size)
            if len(over):
                skip = size - position[over] % size
                yield rows(batch, over, skip, lengths[over] - skip, position[over] + skip)

    def rows(batch: pa.RecordBatch, which: np.ndarray, skip: np.ndarray, length: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
        own, ids = batch.take(pa.array(which)), batch.column("ids")
        if (length < own.column("length").to_numpy()).any():
            ids = pa.array([ids[i].as_py()[4 * s : 4 * (s + n)] for i, s, n in zip(which.tolist(), skip.tolist(), length.tolist(), strict=True)], pa.binary())
        start = pa.array(own.column("start").to_numpy() + skip)
        columns = [own.column("doc_id"), start, pa.array(length.astype(np.int32)), own.column("doc_tokens"), pa.array(position // size), pa.array(position % size), ids]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = cut.join(offsets, ["shard", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.drop("shard", "before", "nth").mapInArrow(placed, "doc_id long, start long, length int, doc_tokens long, sequence_id long, offset long, ids binary")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids: one row per piece, with a checksum of its ids."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
