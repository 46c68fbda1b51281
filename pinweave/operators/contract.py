"""Contraction, projection and extraction of hypergraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.operators.filters import drop_singletons
from pinweave.operators.match import small
from pinweave.operators.model import Hypergraph
from pinweave.storage import settled


def cluster_weights(g: Hypergraph, match: DataFrame) -> DataFrame:
    """(v, w): vertices of the coarse graph."""
    return g.verts.join(match, "v").groupBy("c").agg(F.sum("w").alias("w")).select(F.col("c").alias("v"), "w")


#: Hyperedges of so many pins at most may be a row each.
SHORT = 1024


def _contract_short(g: Hypergraph, match: DataFrame) -> Hypergraph:
    """``contract`` where no hyperedge is long: a hyperedge is a sorted list of clusters, and equal lists are one group."""
    mapped = g.pins.join(small(match, match.count()), "v").groupBy("e").agg(F.sort_array(F.collect_set("c")).alias("held")).where("size(held) > 1")
    merged = settled(mapped.join(g.hedges, "e").groupBy("held").agg(F.min("e").alias("e"), F.sum("w").alias("w")), "merged")
    return Hypergraph(cluster_weights(g, match), merged.select("e", "w"), merged.select("e", F.explode("held").alias("v")))


def contract(g: Hypergraph, match: DataFrame, bits: int | None = None) -> Hypergraph:
    """The coarse graph of match (v, c): pins mapped, hyperedges of one pin dropped, equal ones merged with summed weight.

    Hyperedges that may be equal agree in size, ends and two sums of hashes (of so many ``bits``), aggregated on both sides of
    the exchange, so a long hyperedge is never one row. Those are compared pin by pin with the first of
    them, and what differs from it among itself, until nothing is left. A merged hyperedge keeps the smallest id.
    Where no hyperedge has more than ``SHORT`` pins and no ``bits`` are given, lists of pins are compared as they are.
    """
    if bits is None:
        longest = g.pins.groupBy("e").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (longest or 0) <= SHORT:
            return _contract_short(g, match)
        bits = 64
    pins = settled(g.pins.join(small(match, match.count()), "v").select("e", F.col("c").alias("v")).distinct(), "pins")
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    sums = [F.bit_xor(F.xxhash64(*x)).bitwiseAND(mask).alias(f"h{i}") for i, x in enumerate((["v"], [F.lit(1), "v"]))]
    key = ["n", "lo", "hi", "h0", "h1"]
    sets = pins.groupBy("e").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), *sums).where("n > 1")
    left, merged = settled(sets, "sets"), None
    while True:
        first = settled(left.join(left.groupBy(*key).agg(F.min("e").alias("first")), key), "groups")
        rest = first.where("e <> first")
        shared = pins.join(rest.select("e", "n", "first"), "e").join(pins.select(F.col("e").alias("first"), "v"), ["first", "v"])
        equal = settled(shared.groupBy("e", "first", "n").agg(F.count("*").alias("both")).where("both = n").select("e", "first"), "equal")
        own = equal.unionByName(first.where("e = first").select("e", "first"))
        merged = own if merged is None else merged.unionByName(own)
        left = settled(rest.drop("first").join(equal.select("e"), "e", "left_anti"), "sets")
        if left.isEmpty():
            break
    hedges = merged.join(g.hedges, "e").groupBy(F.col("first").alias("e")).agg(F.sum("w").alias("w"))
    return Hypergraph(cluster_weights(g, match), hedges, pins.join(merged.where("e = first").select("e"), "e", "left_semi"))


def project(match: DataFrame, parts: DataFrame) -> DataFrame:
    """Partitions of the coarse graph, all at once, on the fine vertices."""
    coarse = parts.withColumnRenamed("v", "c")
    return match.join(coarse, "c").select("v", *[c for c in parts.columns if c != "v"]).select(*parts.columns)


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """(v, c): two matches after one another."""
    return first.withColumnRenamed("c", "mid").join(then.select(F.col("v").alias("mid"), "c"), "mid").select("v", "c")


def side(g: Hypergraph, parts: DataFrame, part: int) -> Hypergraph:
    """The hypergraph inside one part: its vertices, and hyperedges that keep two pins or more."""
    own = parts.where(F.col("part") == part).select("v")
    return drop_singletons(Hypergraph(g.verts.join(own, "v", "left_semi"), g.hedges, g.pins.join(own, "v", "left_semi").select("e", "v")))


def clique_edges(g: Hypergraph) -> DataFrame:
    """(a, b), a < b: each pair of vertices that share a hyperedge, once."""
    other = g.pins.select("e", F.col("v").alias("b"))
    return g.pins.withColumnRenamed("v", "a").join(other, "e").where("a < b").select("a", "b").distinct()


def range_lookup(keys: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """keys(v) joined to ranges(lo, hi, owner), lo <= v < hi, by buckets of ``width`` ids: an equi-join, however many ranges."""
    spread = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return keys.withColumn("bucket", F.floor(F.col("v") / width)).join(spread, "bucket").where("lo <= v AND v < hi").select("v", "owner")


def fine_grain(entries: DataFrame, columns: int) -> Hypergraph:
    """The 2-D model of matrix entries (row, col): a vertex per nonzero, a hyperedge per column and per row.

    A missing diagonal entry becomes a vertex of weight 0. Vertex (r, c) has id
    c * rows + r in a common grid, so no global numbering is needed; row r is
    hyperedge ``columns`` + r.
    """
    cells = entries.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    lines = cells.select(F.col("row").alias("i")).unionByName(cells.select(F.col("col").alias("i"))).distinct()
    dummy = lines.join(cells.where("row = col").select(F.col("row").alias("i")), "i", "left_anti").select(F.col("i").alias("row"), F.col("i").alias("col"), F.lit(0).cast("long").alias("w"))
    every = cells.withColumn("w", F.lit(1).cast("long")).unionByName(dummy)
    named = every.select((F.col("col") * F.lit(1 << 31) + F.col("row")).alias("v"), "w", "row", "col")
    pins = named.select(F.col("col").alias("e"), "v").unionByName(named.select((F.col("row") + columns).alias("e"), "v"))
    return Hypergraph(named.select("v", "w"), pins.select("e").distinct().select("e", F.lit(1).cast("long").alias("w")), pins)


def column_net(entries: DataFrame, square: bool = True) -> Hypergraph:
    """The 1-D model of matrix entries: rows are vertices, weighing their entries; columns are hyperedges with the diagonal filled in."""
    cells = entries.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct()
    weights = cells.groupBy(F.col("row").alias("v")).agg(F.count("*").alias("w"))
    pins = cells.select(F.col("col").alias("e"), F.col("row").alias("v"))
    if square:
        pins = pins.unionByName(pins.select("e").distinct().select("e", F.col("e").alias("v"))).distinct()
    verts = pins.select("v").distinct().join(weights, "v", "left").select("v", F.coalesce("w", F.lit(0)).cast("long").alias("w"))
    return Hypergraph(verts, pins.select("e").distinct().select("e", F.lit(1).cast("long").alias("w")), pins)
