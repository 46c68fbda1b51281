"""N-gram Jaccard join with R-trees over count vectors.

A document is the set of its word n-grams, as 64-bit hashes; equal sets are one
*node*, named by the set's hash, so copies never meet again after the first
exchange. Tokens are hashed into groups, and a node's group counts are a point.
For two sets the overlap is at most the sum of the smaller counts of each
group, and what a link leaves unshared is at most r = (|A|+|B|)(1-t)/(1+t).

*Cells* deal the index out to tasks: points are parted by size and by equal
coordinates. The groups of a size band are cut into blocks, more than r. Two
linked sets differ by r tokens at most, so all but r of the blocks that one of
them fills are equal in both: equal content of a block is the key of a cell. Of
its b keys a set keeps the r + 1 rarest ones, as two linked sets still share one
of these; so passages that many documents have make no cells. A set that fills
r blocks or fewer also has a cell for each token of its prefix, of which two
such sets that link share one. No link is lost.

*Stars.* In each cell every node is compared to the cell's smallest. Links so
found make components; a cell whose nodes are all in one is done, which settles
groups of thousands of near copies in one comparison per member.

*Trees.* In a cell that still has several components, an R-tree over the points
joins the cell with itself: nodes are parted at the median of the coordinate
that varies most, boxes of 16 stand under boxes of 16 up to one root, and pairs
of boxes are followed down as long as the summed minima of their upper corners
can reach the overlap needed and they hold two components. A first search finds
the groups of nodes that the bound leaves together; each different group comes
back once, with its sets, and the second verifies its pairs exactly, with the
rational threshold, and skips pairs that its own links have put together. So a
cell returns a forest, never more links than members. Large cells are cut into
tiles, whose pairs are tasks.

Components of all links give the class of each node.

Defined results: null and empty texts, and those without a word, have no set
and link with nothing; texts with fewer words than an n-gram are one token of
all their words; repeated rows are equal texts; unlike texts of one id are sets
of their own; among equal ids and ties the smallest doc_id names the class; a
row without an id links like any other, and names no class that has an id; an
empty table gives no rows; further columns are ignored. Two different sets would
be taken for one if their 64-bit hashes met, which is to be expected once in
10^9 documents with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.components import components
from pinweave.llm.tables import give_back, lean, table
from pinweave.storage import discard, settled

#: The fewest groups of a point, and the most tokens per group on average. In a cell, points are folded to the fewest groups of a member.
GROUPS, PER_GROUP = 64, 2
#: Ratio of a size band's end to its begin, and blocks beyond those that may differ, as a share of these.
BAND, SPARE = 1.7, 0.18
#: Members of a box of the tree; members of a tile of a cell, and tokens of all its sets.
FAN, TILE, TILE_TOKENS = 16, 2048, 1 << 21
#: Texts that a task remembers, so as not to describe their copies again, and keys of which it puts equal ones together at once.
SEEN, CHUNK = 1 << 16, 1 << 18
#: Rows of documents whose sets are needed go to all executors up to this many (6 MB); beyond, Spark shuffles.
BROADCAST_ROWS = 1 << 18

_U = np.uint64
_SPARSE = 128


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct n-grams of a text's words, hashed. Only A-Z change case; words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    n = min(n, len(h))
    rolled = np.full(len(h) - n + 1, n, _U)
    for i in range(n):
        rolled = _mix(rolled * _U(0x9E3779B97F4A7C15) + h[i : i + len(rolled)])
    return np.unique(rolled)


def node_of(tokens: np.ndarray) -> int:
    """The name of a set: a hash of its sorted tokens."""
    return int(xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1)


def fine_groups(size: int) -> int:
    """Groups that hold PER_GROUP tokens or less on average, a power of two of at least GROUPS."""
    return max(GROUPS, 1 << max(0, (size - 1) // PER_GROUP).bit_length())


def point_of(tokens: np.ndarray, groups: int) -> np.ndarray:
    """How many tokens each group has; groups are ranges of the upper bits, so halving their number adds up neighbours."""
    return np.bincount((tokens >> _U(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return point.reshape(groups, -1).sum(1, dtype=np.int32)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> int:
    """The summed minima of two points, the finer one folded to the other's groups."""
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        q = folded(q, len(p))
    return int(np.minimum(p, q).sum(dtype=np.int64))


class Threshold:
    """Jaccard similarity of ``num`` / ``den`` or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, a, b):
        """The least overlap with which sets of these sizes link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def unshared(self, total: int) -> int:
        """The most tokens in one only of two linked sets of this total size."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(number, last size) of each band in which a set of this size may meet its like: its own and, near the end, the next."""
        k, begin = 0, 1
        while (end := max(begin, int(begin * BAND))) < size:
            k, begin = k + 1, end + 1
        out = [(k, end)]
        while self.num * (end + 1) <= self.den * size:
            k, begin = k + 1, end + 1
            end = max(begin, int(begin * BAND))
            out.append((k, end))
        return out

    def linked(self, p: np.ndarray, q: np.ndarray) -> bool:
        """Whether two sets of tokens link."""
        both = np.sort(np.concatenate((p, q)))
        return int((both[1:] == both[:-1]).sum()) >= self.needed(len(p), len(q))


def cells(tokens: np.ndarray, t: Threshold) -> tuple[np.ndarray, int, list[int]]:
    """Keys of the cells of a set, the first band in which it may meet its like, and for each band how many keys it may spare.

    The lower byte of a key is its band, the upper bit of that byte marks cells of sparse sets.
    """
    keys, spare = [], []
    bands = t.bands(len(tokens))
    for band, last in bands:
        r = t.unshared(2 * last)
        spare.append(0)
        if r == 0:
            continue  # only equal sets link there, and they are one node
        blocks = r + 2 + ceil(SPARE * r)
        # tokens are uniform in their lower bits: block by range of these, content by the sum of a second hash
        block = ((tokens & _U(0xFFFFFFFF)) * _U(blocks) >> _U(32)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        held = np.flatnonzero(np.diff(block[order], prepend=-1))
        content = np.add.reduceat(_mix(tokens[order] ^ _U(band + 1)), held)
        keys.append(_mix(content + _mix((block[order][held] + (band << 32)).astype(_U))) & ~_U(255) | _U(band))
        spare[-1] = max(0, len(held) - r - 1)
        if len(held) <= r:
            prefix = tokens[: len(tokens) - -(-t.num * len(tokens) // t.den) + 1]
            keys.append(_mix(prefix + _U(band)) & ~_U(255) | _U(band | _SPARSE))
    return (np.concatenate(keys) if keys else np.zeros(0, _U)), bands[0][0], spare


class Tree:
    """An R-tree over count vectors: members in packed order, and levels of boxes from the leaves up to one root."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        self.order = self._packed(np.concatenate((points, sizes[:, None]), 1))
        own, size, c = points[self.order], sizes[self.order], classes[self.order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        upper, least, most, low, high = own, size, size, c, c
        while not self.levels or len(upper) > 1:
            begins = np.arange(0, len(upper), FAN)
            upper, least, most = np.maximum.reduceat(upper, begins), np.minimum.reduceat(least, begins), np.maximum.reduceat(most, begins)
            low, high = np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)
            self.levels.append((upper, least, most, low, high))

    @staticmethod
    def _packed(coordinates: np.ndarray) -> np.ndarray:
        """Members in an order of which each run of FAN is a leaf: parted at a median, again and again."""
        done, left = [], [np.arange(len(coordinates))]
        while left:
            own = left.pop()
            if len(own) <= FAN:
                done.append(own)
                continue
            x = coordinates[own]
            own = own[np.argsort(x[:, x.var(0).argmax()], kind="stable")]
            half = -(-len(own) // (2 * FAN)) * FAN
            left += [own[half:], own[:half]]
        return np.concatenate(done)


def join(points: np.ndarray, sizes: np.ndarray, classes: np.ndarray, tile: np.ndarray, t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different classes that the bound can't rule out, as arrays; over two tiles, only pairs between them."""
    two = bool(tile.any())
    left = np.flatnonzero(tile == 0)
    right = np.flatnonzero(tile == 1) if two else left
    if not len(left) or not len(right):
        return
    a = Tree(points[left], sizes[left], classes[left])
    b = Tree(points[right], sizes[right], classes[right]) if two else a
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (ua, sa, ma, ca, da), (ub, sb, mb, cb, db) = a.levels[la], b.levels[lb]
        near = (t.num * sa[x] <= t.den * mb[y]) & (t.num * sb[y] <= t.den * ma[x]) & ((ca[x] != db[y]) | (cb[y] != da[x]))
        near &= two or la != lb or x <= y
        at = np.flatnonzero(near)
        good = [at[:0]]
        for i in range(0, len(at), 1 << 13):
            p, q = x[at[i : i + (1 << 13)]], y[at[i : i + (1 << 13)]]
            good.append(at[i : i + (1 << 13)][np.minimum(ua[p], ub[q]).sum(1, dtype=np.int64) >= t.needed(sa[p], sb[q])])
        return np.concatenate(good)

    step = np.arange(FAN)
    good = may(x, y)
    x, y = x[good], y[good]
    while la or lb:
        if la >= lb:
            x, y, la = (x[:, None] * FAN + step).ravel(), np.repeat(y, FAN), la - 1
            inside = x < len(a.levels[la][1])
        else:
            x, y, lb = np.repeat(x, FAN), (y[:, None] * FAN + step).ravel(), lb - 1
            inside = y < len(b.levels[lb][1])
        x, y = x[inside], y[inside]
        good = may(x, y)
        x, y = x[good], y[good]
    for i in range(0, len(x), 64):
        p, q = (x[i : i + 64, None, None] * FAN + step[:, None]), (y[i : i + 64, None, None] * FAN + step)
        p, q = (z.ravel() for z in np.broadcast_arrays(p, q))
        inside = (p < len(left)) & (q < len(right)) & (two or p < q)
        p, q = left[a.order[p[inside]]], right[b.order[q[inside]]]
        apart = (classes[p] != classes[q]) & (t.num * np.maximum(sizes[p], sizes[q]) <= t.den * np.minimum(sizes[p], sizes[q]))
        p, q = p[apart], q[apart]
        good = np.minimum(points[p], points[q]).sum(1, dtype=np.int64) >= t.needed(sizes[p], sizes[q])
        if good.any():
            yield p[good], q[good]


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Members that pairs put together, for each such group of the ``n``."""
    label = np.arange(n)
    for x, y in pairs:
        while len(x):
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if len(x):
                p, q = sorted((label[x[0]], label[y[0]]))
                label[label == q] = p
    order = np.argsort(label, kind="stable")
    return [own for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(own) > 1]


def forest(points: np.ndarray, sizes: np.ndarray, classes: np.ndarray, tokens: list[np.ndarray], t: Threshold) -> Iterator[tuple[int, int]]:
    """Links between members, verified on their sets, that put classes together which no link before has."""
    names, own = np.unique(classes, return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for xs, ys in join(points, sizes, classes, np.zeros(len(own), int), t):
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            p, q = root(int(own[x])), root(int(own[y]))
            if p != q and t.linked(tokens[x], tokens[y]):
                parent[p] = q
                yield x, y


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of ``most`` rows, or fewer with ``most_bytes`` in their binary values."""
    held: list[tuple] = []
    n_bytes = 0
    for row in rows:
        held.append(row)
        n_bytes += sum(len(x) for x in row if type(x) is bytes)
        if len(held) >= most or n_bytes >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
            held, n_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
    held = []
    give_back()


def describe(docs: DataFrame, n: int, t: Threshold) -> DataFrame:
    """doc_id, text_key, n_shingles and node (null without a set) of every row; a task's first of a node has its point, its cells and what it may spare."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("fine", pa.binary()), ("cells", pa.binary()), ("band", pa.int32()), ("spare", pa.list_(pa.int32()))])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: dict[int, tuple] = {}
        for batch in batches:
            texts = batch.column("text")
            for i, (doc_id, text_key) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), strict=True)):
                if text_key in seen:
                    yield doc_id, text_key, *seen[text_key], None, None, None, None
                    continue
                s = shingles(texts[i].as_py(), n)
                node = node_of(s) if len(s) else None
                if len(seen) < SEEN:
                    seen[text_key] = (len(s), node)
                if node is None:
                    yield doc_id, text_key, 0, None, None, None, None, None
                else:
                    keys, band, spare = cells(s, t)
                    # hashes spread distinct tokens, so no group of a few comes near 255
                    yield doc_id, text_key, len(s), node, point_of(s, fine_groups(len(s))).astype(np.uint8).tobytes(), keys.tobytes(), band, spare

    return docs.mapInArrow(described, "doc_id long, text_key long, n_shingles long, node long, fine binary, cells binary, band int, spare array<int>")


def nodes_of(described: DataFrame) -> DataFrame:
    """One row per node: rep, its smallest id; at, the row to read it from; and what describes it."""
    once = [F.first(x, ignorenulls=True).alias(x) for x in ("n_shingles", "fine", "band", "spare")]
    return described.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(_place()).alias("at"), *once)


def _place() -> Column:
    """What orders rows: by id, rows without one last, and by text among those of one id."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")


def shared_cells(described: DataFrame) -> DataFrame:
    """(key, node) of the cells that several nodes have.

    Several tasks may have described a node. A task first looks for equal keys among its own: of these one row goes to
    where the key is dealt, and the others anywhere, so that no task gets the
    rows of a cell that very many nodes have.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for batch in batches:
            for node, own in zip(batch.column("node").to_pylist(), batch.column("cells"), strict=True):
                keys.append(np.frombuffer(own.as_buffer(), np.int64))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                held += len(keys[-1])
                if held >= CHUNK:
                    yield rows(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes, held = [], [], 0
        if held:
            yield rows(np.concatenate(keys), np.concatenate(nodes))
        keys, nodes = [], []
        give_back()

    def rows(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same = key[1:] == key[:-1]
        again = np.concatenate(([False], same))
        route = np.where(again, _mix((key ^ node).astype(_U)).view(np.int64), key)
        return pa.RecordBatch.from_arrays([pa.array(route), pa.array(node), pa.array(key, mask=~(again | np.concatenate((same, [False]))))], ["route", "node", "key"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_node, waiting = None, None, False
        for batch in batches:
            route, node, column = batch.column("route").to_numpy(), batch.column("node").to_numpy(), batch.column("key")
            known = column.is_valid().to_numpy(zero_copy_only=False)
            key = column.fill_null(0).to_numpy()
            dealt_on = known & (key != route)
            yield pair(key[dealt_on], node[dealt_on])
            key, node, known = route[~dealt_on], node[~dealt_on], known[~dealt_on]
            if len(key):
                again = np.concatenate(([key[0] == last and node[0] == last_node], (key[1:] == key[:-1]) & (node[1:] == node[:-1])))
                some = ~again | known
                key, node, known = key[some], node[some], known[some]
            if len(key):
                same = key[1:] == key[:-1]
                goes_on = last is not None and key[0] == last
                if goes_on and waiting:
                    yield pair(key[:1], np.array([last_node]))
                out = known | np.concatenate(([goes_on], same)) | np.concatenate((same, [False]))
                yield pair(key[out], node[out])
                last, last_node, waiting = key[-1], node[-1], not out[-1]

    def pair(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

    placed = described.where("cells IS NOT NULL").select("node", "cells").mapInArrow(dealt, "route long, node long, key long")
    return placed.repartition("route").sortWithinPartitions("route", "node").mapInArrow(met, "key long, node long").distinct()


def rarest(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``members`` without the most frequent cells of each node, as many as it may spare, and without cells of one node."""
    often = members.groupBy("key").agg(F.count("*").alias("n"))
    spare = F.when(F.col("key").bitwiseAND(_SPARSE) > 0, 0).otherwise(F.get("spare", F.col("key").bitwiseAND(_SPARSE - 1).cast("int") - F.col("band")))
    known = members.join(often, "key").join(nodes.select("node", "band", "spare"), "node").select("key", "node", "n", F.col("key").bitwiseAND(255).alias("kind"), spare.alias("spare"))
    rank = F.row_number().over(Window.partitionBy("node", "kind").orderBy(F.desc("n"), "key"))
    return known.withColumn("rank", rank).where("rank > spare").select("key", "node")


class Texts(NamedTuple):
    """The rows of documents, with text_key, and how they become sets."""

    docs: DataFrame
    nodes: DataFrame
    n: int

    def sets(self, needed: DataFrame, name: str) -> DataFrame:
        """(node, tokens) of the nodes named, each once, from the one row of it that ``at`` names."""
        places = settled(needed.join(self.nodes.select("node", "at"), "node").select("node", F.col("at.doc_id").alias("_id"), F.col("at.text_key").alias("_key")), f"{name}-places")
        few = F.broadcast if places.count() <= BROADCAST_ROWS else lambda x: x
        n = self.n

        def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((node, shingles(text.as_py(), n).tobytes()) for batch in batches for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True))
            return _batches(rows, pa.schema([("node", pa.int64()), ("tokens", pa.binary())]))

        own = self.docs.join(few(places), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        return settled(own.select("node", "text").mapInArrow(as_sets, "node long, tokens binary").dropDuplicates(["node"]), name, compression="none")


def verified(pairs: DataFrame, texts: Texts, t: Threshold) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                needed = t.needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                bounds = [overlap_bound(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column("pa"), batch.column("pb"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(np.array(bounds) >= needed))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [t.linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = texts.nodes.select("node", "n_shingles", "fine")
    with_points = pairs.join(own.toDF("a", "na", "pa"), "a").join(own.toDF("b", "nb", "pb"), "b").where(t.num * F.greatest("na", "nb") <= t.den * F.least("na", "nb"))
    left = settled(with_points.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(bounded, "a long, b long"), "survivors")
    sets = texts.sets(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct(), "star-sets")
    joined = left.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return settled(joined.mapInArrow(linked, "a long, b long"), "linked")


def tree_links(members: DataFrame, classes: DataFrame, texts: Texts, t: Threshold) -> DataFrame:
    """Links (a, b) that the trees find in cells of several classes; a forest of each tile or pair of tiles."""
    named = members.join(classes.select(F.col("v").alias("node"), "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("c"))
    sized = named.join(texts.nodes.select("node", "n_shingles"), "node")
    tiles = F.ceil(F.greatest(F.col("members") / TILE, F.col("tokens") / TILE_TOKENS)).cast("int")
    open_cells = sized.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("members"), F.sum("n_shingles").alias("tokens")).where("c1 < c2").select("key", tiles.alias("tiles"))
    tiled = sized.join(open_cells, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = tiled.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    dealt = settled(dealt.select("key", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "tile", "node", "c", "n_shingles"), "open")
    place = ["key", "i", "j"]
    found = pa.schema([(x, pa.int64()) for x in ("group", "node", "c", "n_shingles")])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[int, ...]]:
            for (_, i, _), (tile, node, c, size), fine in _runs(batches, place, ["tile", "node", "c", "n_shingles"], "fine"):
                points = [np.frombuffer(x, np.uint8) for x in fine]
                groups = min(map(len, points))
                points = np.stack([folded(x, groups) for x in points])
                for own in joined(len(node), join(points, size, c, (tile != i).astype(int), t)):
                    name = xxhash.xxh3_64_intdigest(np.sort(node[own]).tobytes()) >> 1
                    for k in own.tolist():
                        yield name, node[k], c[k], size[k]

        return _batches(groups(), found)

    pointed = dealt.join(texts.nodes.select("node", "fine"), "node").select(*place, "tile", "node", "c", "n_shingles", "fine")
    grouped = pointed.repartition(*place).sortWithinPartitions(*place, "node").mapInArrow(searched, "group long, node long, c long, n_shingles long")
    left = settled(grouped.distinct(), "partners")  # the same group is found in many cells
    sets = texts.sets(left.select("node").distinct(), "tree-sets")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for _, (node, c, size), held in _runs(batches, ["group"], ["node", "c", "n_shingles"], "tokens"):
                tokens = [np.frombuffer(x, _U) for x in held]
                points = np.stack([point_of(x, fine_groups(int(size.min()))) for x in tokens])
                for x, y in forest(points, size, c, tokens, t):
                    yield min(node[x], node[y]), max(node[x], node[y])

        return _batches(links(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    discard(dealt)
    with_sets = left.join(sets, "node").select("group", "node", "c", "n_shingles", "tokens")
    return settled(with_sets.repartition("group").sortWithinPartitions("group", "node").mapInArrow(linked, "a long, b long").distinct(), "tree-links")


def _runs(batches: Iterator[pa.RecordBatch], place: list[str], columns: list[str], payload: str) -> Iterator[tuple]:
    """(place, columns, payload) of each run of rows of one place: a value for each name in the first, for each member in the others."""
    kept: tuple[list[np.ndarray], list[bytes]] | None = None
    k = len(place)
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(x).to_numpy().astype(np.int64) for x in (*place, *columns)]
        held = batch.column(payload).to_pylist()
        if kept is not None:
            own, held = [np.concatenate(x) for x in zip(kept[0], own, strict=True)], kept[1] + held
        begins = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in own[:k]], axis=0))))
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            yield [int(x[a]) for x in own[:k]], [x[a:b] for x in own[k:]], held[a:b]
        last = int(begins[-1])
        kept = [x[last:] for x in own], held[last:]  # the last run may go on: two tiles at most
    if kept is not None:
        yield [int(x[0]) for x in kept[0][:k]], kept[0][k:], kept[1]


class Classes(NamedTuple):
    rows: DataFrame  # doc_id, text_key, n_shingles, node of every document
    nodes: DataFrame  # node, component_id, at: the smallest id and the first row of the node's class


def classes(docs: DataFrame, n: int, num: int, den: int) -> Classes:
    """The class of every node under links of similarity ``num``/``den`` between sets of ``n``-grams."""
    t = Threshold(num, den)
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    described = settled(describe(docs, n, t), "described")
    nodes = settled(nodes_of(described), "nodes")
    texts = Texts(docs, nodes, n)

    shared = settled(shared_cells(described), "shared")
    rows = settled(described.select("doc_id", "text_key", "n_shingles", "node"), "rows")
    discard(described)
    members = settled(rarest(shared, nodes), "members")
    discard(shared)
    least = members.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    near = verified(members.join(least, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), texts, t)
    links = near.unionByName(tree_links(members, components(near), texts, t))

    found = components(links).withColumnRenamed("v", "node")
    first = found.join(nodes.select("node", "rep", "at"), "node").groupBy("c").agg(F.min("rep").alias("component_id"), F.min("at").alias("first"))
    named = nodes.select("node", "rep", "at").join(found, "node", "left").join(first, "c", "left")
    # a class without any id has no name: its rows have none to give
    named = named.select("node", F.when(F.col("c").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", "at").alias("at"))
    return Classes(rows, settled(named, "classes"))


def classes_of(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, for n-grams of ``n`` words and a similarity of ``num``/``den``."""
    rows, nodes = classes(docs, n, num, den)
    named = rows.join(nodes.select("node", "component_id"), "node", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of ``docs`` for each class, and every row without a set; all columns pass through.

    It is the row of the smallest id; of unlike texts of that id the one whose
    hash is smallest, and of rows equal in both the smallest in all columns.
    """
    rows, nodes = classes(docs, n, num, den)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_key"))

    def at(other: DataFrame):
        return keyed["_id"].eqNullSafe(other["doc_id"]) & (keyed["_key"] == other["text_key"])

    of_sets = rows.where("node IS NOT NULL")
    firsts = (F.col("doc_id").eqNullSafe(F.col("at.doc_id"))) & (F.col("text_key") == F.col("at.text_key"))
    dropped = settled(of_sets.join(nodes.select("node", "at"), "node").where(~firsts).select("doc_id", "text_key").distinct(), "dropped")
    again = settled(of_sets.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key"), "again")
    again = again.join(dropped, again["doc_id"].eqNullSafe(dropped["doc_id"]) & (again["text_key"] == dropped["text_key"]), "left_anti")
    gone = settled(dropped.unionByName(again), "gone")
    few = F.broadcast if gone.count() <= BROADCAST_ROWS else lambda x: x
    kept = keyed.join(few(gone), at(gone), "left_anti").select("row.*")
    if again.isEmpty():
        return kept
    once = keyed.join(few(again), at(again), "left_semi").groupBy("_id", "_key").agg(F.min("row").alias("row")).select("row.*")
    return kept.unionByName(once)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under links of 0.9 over sets of three-word shingles."""
    return classes_of(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
