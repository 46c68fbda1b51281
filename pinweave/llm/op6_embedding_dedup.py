"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

Equal vectors of a label are one class from the first exchange on. A rotation
of the leading principal axes, fitted on a bounded sample so that signs lose
least, gives balanced binary codes. Each table indexes a substring of some bits
of the code; vectors of a label that agree in one share a cell. In a cell,
blocks of original vectors are multiplied in double precision and only pairs at
the threshold count.

How long the substrings are and how many tables there are is measured on the
sample: they get longer with the number of vectors, so that cells stay small,
and as many tables are taken as find ``RECALL`` of pairs at the threshold, both
real ones of the sample and made ones, whose difference points like noise or like
the difference of two other vectors. Where no number up to ``TABLES`` does, the
substrings get shorter, down to single bits, at which nearly all pairs of a label
meet. So vectors in one narrow cone cost more and are not missed.

A pair that shares several cells counts in the first table where it agrees, so
counts need no list of pairs: a cell gives each class the number of vectors it
is linked to there, and a spanning forest of its links. Cells above ``TILE``
classes are cut into tiles, and pairs of tiles are tasks of their own.

The fit is on ``SAMPLE`` vectors at most (lowest by hash); all are indexed.

Defined results: null, empty and zero vectors, those with null or non-finite
components, and those without a label link with nothing and are kept; vectors
of different lengths never link; repeated rows are vectors of their own that
link with each other; ties go to the smallest vec_id; null vec_ids are kept
only if nothing with an id is in their class; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pinweave.llm.components import components
from pinweave.llm.tables import table
from pinweave.storage import settled

SAMPLE = 4000
#: Bits of a code, the most tables and the most bits of a substring.
BITS, TABLES, LONGEST = 64, 32, 24
#: Share of pairs at the threshold that the tables must find on the sample, pairs that are looked at, and classes that a cell should hold.
RECALL, PAIRS, CELL = 0.985, 2000, 64
TILE = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, n_bits: int = BITS, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are codes: principal axes, rotated by iterative quantisation."""
    x = _unit(sample)
    mean = x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2].T
    n_bits = min(n_bits, axes.shape[1])
    v = (x - mean) @ axes[:, :n_bits]
    r = np.linalg.qr(np.random.default_rng(11).standard_normal((n_bits, n_bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes[:, :n_bits] @ r


def bits(x: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Each vector's code. Vectors of a length the sample lacks use their own signs."""
    x = _unit(x)
    return ((x if model is None else (x - model[0]) @ model[1]) >= 0)[:, :BITS]


def hard_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors at a cosine of the threshold or little more: made with noise, made with differences of the sample, and real ones."""
    x = _unit(sample)
    rng = np.random.default_rng(23)
    n, d = x.shape
    own = x[rng.integers(0, n, PAIRS)]
    out = []
    for away in (rng.standard_normal((PAIRS, d)), x[rng.integers(0, n, PAIRS)] - x[rng.integers(0, n, PAIRS)]):
        away = away - (away * own).sum(1, keepdims=True) * own
        size = np.linalg.norm(away, axis=1)
        some = size > 1e-9
        if some.any():
            out.append((own[some], threshold * own[some] + np.sqrt(1 - threshold**2) * away[some] / size[some, None]))
    few = x[rng.permutation(n)[:PAIRS]]
    close = np.triu(few @ few.T, 1)
    for least, most in ((threshold, threshold + (1 - threshold) / 4), (threshold, 2.0)):
        a, b = np.nonzero((close >= least) & (close < most))
        if len(a) >= 30:
            chosen = rng.permutation(len(a))[:PAIRS]
            out.append((few[a[chosen]], few[b[chosen]]))
            break
    return out


def tables(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray], members: int, threshold: float) -> list[np.ndarray]:
    """The places of the bits that each table indexes, for labels of up to ``members`` classes."""
    n_bits = min(BITS, model[1].shape[1])
    flips = [bits(a, model) != bits(b, model) for a, b in hard_pairs(sample, threshold)]
    longest = min(LONGEST, n_bits, max(1, int(np.ceil(np.log2(max(2.0, members / CELL))))))
    for length in range(longest, 0, -1):
        # permutations of the code, cut into substrings
        rng = np.random.default_rng(31)
        places: list[np.ndarray] = []
        most = TABLES if length > 1 else n_bits
        while len(places) < most:
            order = rng.permutation(n_bits)
            places += [order[i : i + length] for i in range(0, n_bits - length + 1, length)]
        found = [np.zeros(len(f), bool) for f in flips]
        for k, place in enumerate(places[:most]):
            found = [hit | ~f[:, place].any(1) for hit, f in zip(found, flips, strict=True)]
            if all(hit.mean() >= RECALL for hit in found):
                return places[: k + 1]
    return [np.array([i]) for i in range(n_bits)]


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None, places: list[np.ndarray]) -> np.ndarray:
    """Substrings of each vector's code, one column a table."""
    signs = bits(x, model)
    return np.stack([signs[:, p[p < signs.shape[1]]] @ (1 << np.arange((p < signs.shape[1]).sum())) for p in places], 1).astype(np.int64)


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.float64).reshape(-1, d)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal (key, i, j). A run has two tiles at most."""
    held: list[pa.RecordBatch] = []

    def name(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(b.column(x)[k].as_py() for x in ("key", "i", "j"))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(x).to_numpy() for x in ("key", "i", "j")]
        changes = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            own = batch.slice(a, b - a)
            if held and name(held[0], 0) != name(own, 0):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(own)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def classes_of(vectors: DataFrame, threshold: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(kind))
    sound = F.size("embedding") > 0
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own = own.withColumn("class", F.when(F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull(), F.xxhash64("label", "embedding")))
    all_classes = own.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = settled(all_classes, "classes")

    drawn = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("embedding").toPandas()["embedding"]
    by_length: dict[int, list] = {}
    for x in drawn:
        by_length.setdefault(len(x), []).append(x)
    largest = {r.d: r.n for r in classes.groupBy("label", F.size("embedding").alias("d")).agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()}  # a row for each length of vectors
    models = {}
    for d, x in by_length.items():
        drawn_ = np.array(x, np.float64)
        model = fit(drawn_)
        models[d] = model, tables(drawn_, model, largest[d], threshold)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                found = codes(_matrix(lists.take(pa.array(rows)), int(d)), *models.get(int(d), (None, [np.arange(i, i + 1) for i in range(min(BITS, int(d)))])))
                lists_ = pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * found.shape[1]).astype(np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("class", "n", "label", "embedding")), lists_], ["class", "n", "label", "embedding", "code"])

    coded = settled(classes.select("class", "n", "label", "embedding").mapInArrow(indexed, f"class long, n long, label long, embedding {kind}, code array<long>"), "codes")
    placed = coded.select("*", F.posexplode("code").alias("table", "part"))
    placed = placed.withColumn("key", F.xxhash64("label", F.size("embedding"), "table", "part"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    tiles = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    tiled = placed.join(sizes, "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    dealt = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("key", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "table", "class", "n", "label", "code", "embedding")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, n, at = (group.column(c).to_numpy() for c in ("class", "n", "table"))
            x = _unit(_matrix(group.column("embedding"), len(group.column("embedding")[0])))
            code = _matrix(group.column("code"), len(group.column("code")[0])).astype(np.int64)
            same = group.column("i")[0] == group.column("j")[0]
            left = np.flatnonzero(group.column("tile").to_numpy() == group.column("i")[0].as_py())
            right = left if same else np.flatnonzero(group.column("tile").to_numpy() == group.column("j")[0].as_py())
            a, b = np.nonzero(np.triu(x[left] @ x[right].T >= threshold, 1) if same else x[left] @ x[right].T >= threshold)
            a, b = left[a], right[b]
            table_ = int(at[0])
            first = ~(code[a, :table_] == code[b, :table_]).any(1) if table_ else np.ones(len(a), bool)
            linked = np.bincount(a[first], n[b[first]], len(ids)) + np.bincount(b[first], n[a[first]], len(ids))
            root = np.arange(len(ids))
            while len(a):
                before = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                root = root[root]
                if (root == before).all():
                    break
            some = np.flatnonzero((linked > 0) | (root != np.arange(len(ids))))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(linked[some].astype(np.int64))], ["a", "b", "n"])

    found = settled(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compared, "a long, b long, n long"), "found")
    linked = found.groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "class")
    group = components(found.select("a", "b")).withColumnRenamed("v", "class")
    smallest = group.join(classes.select("class", "rep"), "class").groupBy("c").agg(F.min("rep").alias("least"))
    of_class = classes.select("class", "rep", "n").join(linked, "class", "left").join(group, "class", "left").join(smallest, "c", "left")
    of_class = settled(of_class.select("class", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "of_class")
    out = own.select("vec_id", "class").join(of_class, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, class and verdict of every vector."""
    return classes_of(table(spark, sf_dir, "embeddings"))
