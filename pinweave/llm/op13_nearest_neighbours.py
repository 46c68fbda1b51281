"""Nearest neighbours by largest inner product, by multi-index hashing of learned binary codes.

Vectors are lengthened by one component that gives all of them the norm of the
longest, and queries by a zero, which turns the largest inner product into the
smallest angle. A rotation learned by iterative quantisation on a bounded sample makes
binary codes of them. A code is split into substrings, each indexed by its
value. Two codes within a radius of r differ by at most floor(r / m) bits in one
of their m substrings, and by less in the later ones (pigeonhole), so probing each
index with all values so close to the query's retrieves every code within the
radius, and none is retrieved twice. All codes within the radius are
reranked by inner products of the original vectors in double precision.

The radius is measured on the sample: the smallest at which ``RECALL`` of the exact neighbours of sampled
queries are found. As the sample is thinner than the table, its neighbours are
farther away, which errs on the side of a larger radius. A query with fewer
than k codes within it looks further, up to the nearest k codes, so it gets k answers.

Rows and queries are dealt into tiles of bounded size, and each pair of tiles is a
task's work with an index of its own; so the stated queries meet all rows in blocks,
and a task holds two tiles. Each gives its k best, which are cut to k a query before they
are shuffled and after.

The fit is on ``SAMPLE`` vectors at most (lowest by hash); all are indexed.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, and rows without vec_id take no part; vectors of unlike lengths are
no candidates of each other; a row with the query's vec_id is never its
candidate; repeated query rows are answered once, unlike ones of one id each;
repeated candidates come as often as they are there; equal scores go by vec_id; an empty table, or one without queries,
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.op6_embedding_dedup import fit
from pinweave.llm.tables import table
from pinweave.storage import settled

SAMPLE, PROBES = 4000, 400
#: Bits of a code and of a substring; sampled neighbours that the radius must reach.
BITS, SUBSTRING, RECALL = 64, 8, 0.97
#: Rows and queries of a tile, bytes of either in double precision, and queries that are answered at once.
TILE, QUERY_TILE, TILE_BYTES, AT_ONCE = 8192, 32768, 64 << 20, 4096
#: Tasks that pairs of tiles are dealt to at most.
TASKS = 20_000


class Codes:
    """The codes of vectors of one length: lengthened to one norm, rotated, signs taken."""

    def __init__(self, sample: np.ndarray, longest: float, total: int, k: int):
        self.longest = longest
        own = self.lengthened(sample)
        self.mean, self.projection = fit(own, min(BITS, own.shape[1]))
        self.n_bits = self.projection.shape[1]
        self.radius = self._radius(sample, total, k)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        return np.column_stack([scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))])

    def of(self, lengthened: np.ndarray) -> np.ndarray:
        """Codes as whole numbers of 64 bits."""
        length = np.linalg.norm(lengthened, axis=1, keepdims=True)
        signs = (lengthened / np.where(length > 0, length, 1) - self.mean) @ self.projection >= 0
        return np.packbits(np.pad(signs, ((0, 0), (0, 64 - self.n_bits))), axis=1, bitorder="little").view("<u8").ravel()

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self.of(np.column_stack([x / self.longest, np.zeros(len(x))]))

    def _radius(self, sample: np.ndarray, total: int, k: int) -> int:
        """The least radius that holds enough of the neighbours of sampled queries among the sample."""
        queries = np.arange(0, len(sample), max(1, len(sample) // PROBES))
        score = (sample[queries] / self.longest) @ (sample / self.longest).T
        score[np.arange(len(queries)), queries] = -np.inf
        near = min(k, len(sample) - 1, max(5, -(-k * len(sample) // max(total, 1))))
        if near < 1:
            return self.n_bits
        best = np.argpartition(-score, near - 1, axis=1)[:, :near]
        apart = np.bitwise_count(self.of_queries(sample[queries])[:, None] ^ self.of(self.lengthened(sample))[best])
        return int(np.quantile(apart, RECALL, method="higher"))


class Index:
    """A tile's codes by the values of their substrings."""

    def __init__(self, code: np.ndarray, n_bits: int):
        self.code = code
        self.tables = -(-n_bits // SUBSTRING)
        self.order, self.starts = [], []
        for t in range(self.tables):
            value = self.substring(code, t)
            self.order.append(np.argsort(value, kind="stable"))
            self.starts.append(np.searchsorted(value[self.order[-1]], np.arange((1 << SUBSTRING) + 1)))

    @staticmethod
    def substring(code: np.ndarray, t: int) -> np.ndarray:
        return (code >> np.uint64(SUBSTRING * t)).astype(np.int64) & ((1 << SUBSTRING) - 1)

    def reach(self, radius: int) -> list[int]:
        """Bits by which each substring is probed: r = m s + a, s bits in the first a + 1 of them and s - 1 in the others."""
        s, a = divmod(radius, self.tables)
        return [s if t <= a else s - 1 for t in range(self.tables)]

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which (query, row) codes are at most ``radius`` apart: probed for, then compared as a whole."""
        hit = np.zeros((len(queries), len(self.code)), bool)
        values = np.arange(1 << SUBSTRING)
        for t, bits in enumerate(self.reach(radius)):
            if bits < 0:
                continue
            asked = self.substring(queries, t)
            for value in np.unique(asked):
                probes = np.flatnonzero(np.bitwise_count(values ^ value) <= bits)
                rows = np.concatenate([self.order[t][self.starts[t][p] : self.starts[t][p + 1]] for p in probes])
                own = np.flatnonzero(asked == value)
                hit[np.ix_(own, rows)] |= np.bitwise_count(queries[own, None] ^ self.code[None, rows]) <= radius
        return hit

    def search(self, queries: np.ndarray, radius: int, k: int, allowed: np.ndarray) -> np.ndarray:
        """As ``within``, of allowed pairs; a query of which fewer than k are there looks as far as its k nearest allowed codes."""
        hit = self.within(queries, radius) & allowed
        few = np.flatnonzero(hit.sum(1) < np.minimum(k, allowed.sum(1)))
        if len(few):
            apart = np.where(allowed[few], np.bitwise_count(queries[few, None] ^ self.code[None]), 255)
            k = min(k, len(self.code))
            hit[few] = (apart <= np.partition(apart, k - 1, axis=1)[:, k - 1 : k]) & allowed[few]
        return hit


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one pair of tiles, which are two tiles at most."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("d", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[a]) != name:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            name = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def nearest(vectors: DataFrame, asks: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found of each row that ``asks``."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind)).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    # the largest component first, or squares of huge ones leave the range
    top = F.array_max(F.transform("embedding", lambda c: F.abs(c).cast("double")))
    norm = top * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, c: a + F.pow(c / top, F.lit(2.0))))
    own = own.select("vec_id", "embedding", F.size("embedding").alias("d"), norm.alias("norm"))
    lengths = {r.d: (r.n, r.norm) for r in own.groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}  # a row for each length of vectors
    drawn: dict[int, list] = {}
    lowest = F.xxhash64("vec_id", "embedding")
    few = own.where(F.pmod(lowest, F.lit(max(1, sum(n for n, _ in lengths.values()) // (4 * SAMPLE)))) == 0)  # so that tasks don't send a sample each
    for r in few.orderBy(lowest, "vec_id").limit(SAMPLE).select("embedding").toLocalIterator():
        drawn.setdefault(len(r.embedding), []).append(r.embedding)
    codes = {d: Codes(np.array(x, np.float64), lengths[d][1], lengths[d][0], k) for d, x in drawn.items() if len(x) > 1}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes, code = batch.column("d").to_numpy(), np.zeros((2, batch.num_rows), np.int64)
            for d in np.unique(sizes):
                if int(d) in codes:
                    rows = np.flatnonzero(sizes == d)
                    x, c = _matrix(batch.column("embedding").take(pa.array(rows))), codes[int(d)]
                    code[0, rows], code[1, rows] = c.of(c.lengthened(x)).view(np.int64), c.of_queries(x).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "embedding", "d")), pa.array(code[0]), pa.array(code[1]), pa.array(nth + np.arange(batch.num_rows))], ["vec_id", "embedding", "d", "code", "asked", "nth"])
            nth += batch.num_rows

    rows = settled(own.select("vec_id", "embedding", "d").mapInArrow(coded, f"vec_id long, embedding {kind}, d int, code long, asked long, nth long"), "codes")
    queries = rows.where(asks).withColumn("key", lowest).dropDuplicates(["vec_id", "key", "embedding"])
    counts = rows.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.expr(f"int({asks})")).alias("q"))
    most = lambda n: F.greatest(F.lit(64), F.least(F.lit(n), F.lit(TILE_BYTES) / (8 * F.col("d"))))
    tiles = counts.select("d", F.ceil(F.col("n") / most(TILE)).cast("int").alias("wide"), F.ceil(F.col("q") / most(QUERY_TILE)).cast("int").alias("high")).where("high > 0")
    n_pairs = tiles.agg(F.sum(F.col("wide").cast("long") * F.col("high"))).first()[0] or 1
    tile = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["d", "i", "j", "asking", "vec_id", "key", "code", "embedding"]
    # tiles has a row for each length of vectors; rows are dealt out by number, so copies of a row are not in one tile
    tiled = rows.join(F.broadcast(tiles), "d").withColumn("i", tile("nth", "wide")).withColumn("j", every("high")).withColumn("asking", F.lit(False)).withColumn("key", F.lit(0).cast("long")).select(columns)
    asked = queries.join(F.broadcast(tiles), "d").withColumn("j", tile("key", "high")).withColumn("i", every("wide")).withColumn("asking", F.lit(True)).withColumn("code", F.col("asked")).select(columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _tile_pairs(batches):
            d = pair.column("d")[0].as_py()
            asking = pair.column("asking").to_numpy(zero_copy_only=False)
            x, ids, keys, code = _matrix(pair.column("embedding")), pair.column("vec_id").to_numpy(), pair.column("key").to_numpy(), pair.column("code").to_numpy().view(np.uint64)
            q, r = np.flatnonzero(asking), np.flatnonzero(~asking)
            if not len(q) or not len(r):
                continue
            index = Index(code[r], codes[d].n_bits if d in codes else 1)
            for at in range(0, len(q), AT_ONCE):
                some = q[at : at + AT_ONCE]
                hit = index.search(code[some], codes[d].radius if d in codes else 64, k, ids[some, None] != ids[None, r])
                out: list[tuple[np.ndarray, ...]] = []
                for one, found in zip(some, hit, strict=True):
                    near = r[np.flatnonzero(found)]
                    score = (x[near] * x[one]).sum(1)  # row by row, so that equal rows score alike
                    best = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(best), ids[one]), np.full(len(best), keys[one]), ids[near[best]], score[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "key", "vec_id", "score"])

    pairs = tiled.unionByName(asked).repartition(min(TASKS, n_pairs), "d", "i", "j").sortWithinPartitions("d", "i", "j")
    found = pairs.mapInArrow(search, "query_id long, key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every row whose vec_id 20 divides."""
    return nearest(table(spark, sf_dir, "embeddings"))
