"""Whitening of embeddings by hierarchical merging of singular value decompositions.

A block of vectors is summed up as its size, its exact sums, and all singular
values and right vectors of its centred rows. Two summaries merge without loss:
their values times vectors are stacked, with one row for the step between
their means, and decomposed again. Tasks merge their own batches; their
summaries are rows of a table that shrinks by a factor a round, in tasks
keyed by (length of vectors, slot), until each length of vectors has one.
The driver sees the leading components alone.

Entries are whole numbers, floor(1024 c) + 100000, so sums are exact; the rows are
centred before they are multiplied with anything.

Defined results: vectors that are null or hold null or non-finite entries go,
and so do those with an entry of 2^40 or more, which the whole numbers can't hold;
an empty vector has no component and so no row; vectors of unlike lengths are
whitened apart; a component without variance (one vector, equal vectors) is null,
and takes no part in the identity's error; a deviation above a long is null;
repeated rows and null vec_ids come out as they come in; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm.tables import table
from pinweave.storage import discard, settled

#: Bytes of summaries that one task merges at most (two at least), and of models that go to all tasks.
MERGE_BYTES, MODEL_BYTES = 128 << 20, 256 << 20
#: Rows that are decomposed at once.
BLOCK = 8192
_SUMMARY = "d int, slot long, n long, sums array<decimal(38,0)>, singular array<double>, vectors array<double>"


@dataclass(frozen=True)
class Summary:
    """Size, exact sums, singular values and right vectors (rows) of centred vectors."""

    n: int
    sums: list[int]
    singular: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """Of whole vectors, one a row."""
        sums = x.sum(0).tolist()
        centred = (x * len(x) - x.sum(0)) / len(x) if np.abs(x).max(initial=0) < 2**48 else x - x.mean(0)
        _, s, v = np.linalg.svd(centred, full_matrices=False)
        return Summary(len(x), sums, s, v)

    def merge(self, other: Summary) -> Summary:
        step = np.sqrt(self.n * other.n / (self.n + other.n)) * (other.mean - self.mean)
        rows = np.concatenate([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, step[None]])
        _, s, v = np.linalg.svd(rows, full_matrices=False)
        return Summary(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], s, v)


def _rows(found: dict[int, Summary], slot: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    for d, x in found.items():
        values = [d, slot, x.n, [Decimal(s) for s in x.sums], x.singular, x.vectors.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _SUMMARY.split(", ")])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, which rows, their vectors) of a batch."""
    lists = batch.column("x")
    sizes = np.diff(lists.offsets.to_numpy())
    for d in np.unique(sizes):
        which = np.flatnonzero(sizes == d)
        yield int(d), which, lists.take(pa.array(which)).flatten().to_numpy().reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary for each length of vectors in a task."""
    found: dict[int, Summary] = {}
    for batch in batches:
        for d, _, x in _by_length(batch):
            for at in range(0, len(x), BLOCK):
                own = Summary.of(x[at : at + BLOCK])
                found[d] = found[d].merge(own) if d in found else own
    yield from _rows(found, TaskContext.get().partitionId())


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that remain, as whole numbers."""
    kept = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40)) & (F.size("embedding") > 0)
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.coalesce(kept, F.lit(False)))
    return own.select("vec_id", F.transform("embedding", lambda c: F.floor(c * 1024) + 100000).alias("x"))


def summaries(own: DataFrame) -> DataFrame:
    """One row for each length of vectors: the summary of all of them."""
    now = settled(own.select("x").mapInArrow(_blocks, _SUMMARY), "summaries")
    last, longest = now.agg(F.max("slot"), F.max("d")).first()
    fan = max(2, min(16, MERGE_BYTES // (8 * (longest or 1) ** 2)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (d, slot), so a group is a run; only its merged summary is held."""
        at, held = None, None
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                d, slot, n = (row.column(c)[0].as_py() for c in ("d", "slot", "n"))
                singular = row.column("singular").flatten().to_numpy()
                one = Summary(n, [int(x) for x in row.column("sums")[0].as_py()], singular, row.column("vectors").flatten().to_numpy().reshape(len(singular), d))
                if at is not None and at != (d, slot // fan):
                    yield from _rows({at[0]: held}, at[1])
                    held = None
                at, held = (d, slot // fan), one if held is None else held.merge(one)
        if at is not None:
            yield from _rows({at[0]: held}, at[1])

    while last:
        group = [F.col("d"), F.floor(F.col("slot") / fan)]
        before, now = now, settled(now.repartition(*group).sortWithinPartitions("d", "slot").mapInArrow(merged, _SUMMARY), "summaries")
        discard(before)
        last //= fan
    return now


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # rows are components, by falling variance
    variances: np.ndarray
    explained: np.ndarray


def model(summary: DataFrame, components: int) -> dict[int, Model]:
    """Leading components of each length of vectors; of a component, the largest entry is positive."""
    size = summary.agg(F.sum(F.col("d") * (components + 2) * 8)).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"components take {size} bytes, above {MODEL_BYTES}: too many lengths of vectors")
    leading = F.slice("vectors", F.lit(1), F.least(F.lit(components), F.size("singular")) * F.col("d")).alias("vectors")
    out = {}
    for r in summary.select("d", "n", "sums", "singular", leading).toLocalIterator():
        e = np.array(r.singular) ** 2 / r.n
        k = min(components, r.d)
        v = np.zeros((k, r.d))
        given = np.array(r.vectors).reshape(-1, r.d)
        v[: len(given)] = given
        v *= np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
        variances = np.append(e, np.zeros(k))[:k]
        variances[variances <= e.max(initial=0) * (r.d * np.finfo(float).eps) ** 2] = 0
        out[r.d] = Model(r.n, [int(x) for x in r.sums], v, variances, np.full(k, np.nan) if e.sum() == 0 else variances / e.sum())
    return out


def _deviation(x: np.ndarray, m: Model) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, in whole numbers."""
    off = max(abs(m.n * int(x.max(initial=0)) - min(m.sums)), abs(m.n * int(x.min(initial=0)) - max(m.sums)))
    if off**2 * x.shape[1] < 2**63 and m.n * int(np.abs(x).max(initial=0)) < 2**63 and max(map(abs, m.sums)) < 2**63:
        return ((m.n * x - np.array(m.sums, np.int64)) ** 2).sum(1).tolist()
    found = (sum((m.n * c - s) ** 2 for c, s in zip(row, m.sums, strict=True)) for row in x.tolist())
    return [y if y < 2**63 else None for y in found]


def _centred(x: np.ndarray, m: Model) -> np.ndarray:
    """x - S/n: the whole part of the mean goes first, exactly."""
    base = np.array([s // m.n for s in m.sums], np.int64)
    return (x - base) - np.array([s % m.n / m.n for s in m.sums])


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every vector that remains."""
    own = whole(vectors)
    summary = summaries(own)
    models = vectors.sparkSession.sparkContext.broadcast(model(summary, components))  # at most MODEL_BYTES

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, which, x in _by_length(batch):
                m = models.value[d]
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = np.where(m.variances > 0, _centred(x, m) @ m.vectors.T / np.sqrt(m.variances), np.nan)
                k, rows = len(m.variances), len(x)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array(y.ravel(), from_pandas=True)) for y in (white, np.tile(m.explained, (rows, 1)))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(which)), pa.array(np.full(rows, d, np.int32)), pa.array(np.full(rows, m.n)), pa.array(_deviation(x, m), pa.int64()), *lists], ["vec_id", "d", "n", "deviation", "white", "explained"])

    white = settled(own.mapInArrow(project, "vec_id long, d int, n long, deviation long, white array<double>, explained array<double>"), "white")
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    w = [F.get("white", F.lit(i)) for i in range(components)]
    # Spark's covariance is centred as it goes
    sums = white.groupBy("d").agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs])
    errors = [F.abs(F.col(f"c{i}_{j}") - (1 if i == j else 0)) for i, j in pairs]
    error = sums.select("d", F.array_max(F.array(*errors)).alias("identity_error"))
    each = white.select("vec_id", "d", "n", "deviation", "explained", F.posexplode("white").alias("at", "whitened")).join(error, "d")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
