"""Filters, orders and choices among partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinweave.functions.scalars import mixed
from pinweave.operators.metrics import edge_lengths, running
from pinweave.operators.model import Hypergraph


def _only(g: Hypergraph, edges: DataFrame) -> Hypergraph:
    keep = edges.select("e")
    return Hypergraph(g.verts, g.hedges.join(keep, "e", "left_semi"), g.pins.join(keep, "e", "left_semi"))


def drop_singletons(g: Hypergraph) -> Hypergraph:
    """Hyperedges of two pins or more."""
    return _only(g, edge_lengths(g).where("len > 1"))


def length_limit(g: Hypergraph, percentile: float) -> DataFrame:
    """One row, max_len: the length that the percentile filter keeps; null keeps all.

    Taking hyperedges from the shortest on until ``percentile`` % of the weight is
    reached, it is the length of the next one. Lengths are summed as a histogram.
    """
    lens = edge_lengths(g)
    hist = running(lens, "len", "w").withColumn("one", F.lit(1))
    total = lens.agg((F.lit(percentile) * F.sum("w") / 100).alias("enough")).withColumn("one", F.lit(1))
    lightest = lens.groupBy("len").agg(F.min("w").alias("least"))
    # the last hyperedge of a length has all others of that length before it
    last = F.col("cum_before") + F.col("weight") - F.col("least")
    return hist.join(lightest, "len").join(F.broadcast(total), "one").agg(F.min(F.when(last >= F.col("enough"), F.col("len"))).alias("max_len"))


def percentile_filter(g: Hypergraph, percentile: float) -> Hypergraph:
    limit = length_limit(g, percentile).first()[0]
    return g if limit is None else _only(g, edge_lengths(g).where(F.col("len") <= limit))


def length_limit_filter(g: Hypergraph) -> Hypergraph:
    """Hyperedges shorter than half the longest."""
    most = edge_lengths(g).agg(F.max("len")).first()[0] or 0
    return _only(g, edge_lengths(g).where(2 * F.col("len") < most))


def prune_partitions(cuts: DataFrame, threshold: float) -> DataFrame:
    """(pid, cut) with a cut up to best + floor(best * threshold), the first of equal cuts, renumbered as new_pid.

    ``cuts`` has one row per candidate partition: few, whatever the graph.
    """
    best = F.min("cut").over(Window.partitionBy())
    first = F.row_number().over(Window.partitionBy("cut").orderBy("pid"))
    kept = cuts.select("pid", "cut", best.alias("best"), first.alias("n")).where((F.col("cut") <= F.col("best") + F.floor(F.col("best") * threshold)) & (F.col("n") == 1))
    return kept.select("pid", "cut", (F.row_number().over(Window.orderBy("pid")) - 1).cast("long").alias("new_pid"))


def keep_best(cuts: DataFrame) -> DataFrame:
    """The candidate of least cut, the first of equals."""
    return cuts.orderBy("cut", "pid").limit(1)


def visit_key(how: str = "random", seed: int = 0) -> Column:
    """The key of a vertex (v, w) in an order of visits."""
    keys = {"random": mixed(F.col("v"), seed), "increasing": F.col("v"), "decreasing": -F.col("v"), "increasing-weight": F.col("w"), "decreasing-weight": -F.col("w")}
    return keys[how].cast("long")


def visit_order(g: Hypergraph, how: str = "random", seed: int = 0) -> DataFrame:
    """(v, key): ascending (key, v) is the order of visits."""
    return g.verts.select("v", visit_key(how, seed).alias("key"))


def hyperedge_order(g: Hypergraph) -> DataFrame:
    """(e, w, len, key): ascending (key, e) takes short hyperedges first, and heavy before light of one length."""
    return edge_lengths(g).withColumn("key", F.struct("len", (-F.col("w")).alias("lightness")))
