"""Cuts, balance and statistics, as aggregates of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinweave.functions.scalars import part_cap, vertex_cap
from pinweave.operators.model import Hypergraph

PERCENTS = (25, 50, 75, 95)


def _long(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def edge_part_counts(g: Hypergraph, parts: DataFrame) -> DataFrame:
    """(e, part, cnt): pins of each hyperedge in each part."""
    return g.pins.join(parts, "v").groupBy("e", "part").agg(F.count("*").alias("cnt"))


def spans(g: Hypergraph, parts: DataFrame) -> DataFrame:
    """(e, lam, w): the number of parts that each hyperedge spans.

    Pins are counted per (hyperedge, part) first, so no task ever holds a long hyperedge's pins.
    """
    return edge_part_counts(g, parts).groupBy("e").agg(F.count("*").alias("lam")).join(g.hedges, "e")


def cuts(g: Hypergraph, parts: DataFrame) -> DataFrame:
    """(pid, k1_cut, soed) of several partitions (pid, v, part) at once.

    Partitions that come out of an ``explode`` are larger than Spark takes them for, so they are never sent to all.
    """
    counted = g.pins.join(parts.hint("merge"), "v").groupBy("pid", "e", "part").agg(F.count("*").alias("cnt"))
    lam = counted.groupBy("pid", "e").agg(F.count("*").alias("lam")).join(g.hedges, "e")
    return lam.groupBy("pid").agg(_long(F.sum((F.col("lam") - 1) * F.col("w"))).alias("k1_cut"), _long(F.sum(F.when(F.col("lam") > 1, F.col("lam") * F.col("w")))).alias("soed"))


def k1_cut(g: Hypergraph, parts: DataFrame) -> DataFrame:
    return spans(g, parts).agg(_long(F.sum((F.col("lam") - 1) * F.col("w"))).alias("k1_cut"))


def soed(g: Hypergraph, parts: DataFrame) -> DataFrame:
    """Sum of external degrees: spanned parts times weight, of hyperedges that span several."""
    return spans(g, parts).agg(_long(F.sum(F.when(F.col("lam") > 1, F.col("lam") * F.col("w")))).alias("soed"))


def lambda_histogram(g: Hypergraph, parts: DataFrame) -> DataFrame:
    return spans(g, parts).groupBy("lam").agg(F.count("*").alias("n_edges"), _long(F.sum("w")).alias("weight"))


def part_weights(g: Hypergraph, parts: DataFrame, k: int) -> DataFrame:
    """(part, weight) of all k parts; an empty part weighs 0."""
    every = g.verts.sparkSession.range(k).select(F.col("id").cast("long").alias("part"))
    own = g.verts.join(parts, "v").groupBy(F.col("part").cast("long").alias("part")).agg(F.sum("w").alias("weight"))
    return every.join(own, "part", "left").select("part", _long(F.col("weight")).alias("weight"))


def partition_summary(g: Hypergraph, parts: DataFrame, k: int, eps: float) -> DataFrame:
    """One row: cut, the most a part may weigh, the lightest and heaviest part, and whether the balance holds."""
    weights = part_weights(g, parts, k).agg(F.sum("weight").alias("total"), F.min("weight").alias("min_part"), F.max("weight").alias("max_part"))
    most = F.floor(F.col("total") / F.lit(k) * F.lit(1 + eps)).cast("long")
    one = k1_cut(g, parts).withColumn("one", F.lit(1)).join(weights.withColumn("one", F.lit(1)), "one")
    return one.select("k1_cut", most.alias("max_allowed"), "min_part", "max_part", (F.col("max_part") <= most).alias("balanced"))


def validity(g: Hypergraph, parts: DataFrame, k: int, cap: int) -> DataFrame:
    """One row of checks: every vertex has one part in range, and no part is over the cap."""
    held = g.verts.join(parts.select("v", "part", F.lit(1).alias("has")), "v", "left")
    per_vertex = held.groupBy("v").agg(F.count("has").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    ranges = per_vertex.agg(F.bool_and(F.col("n") == 1).alias("covered"), F.bool_and((F.col("lo") >= 0) & (F.col("hi") < k)).alias("in_range"))
    heaviest = part_weights(g, parts, k).agg((F.max("weight") <= cap).alias("balanced"))
    return ranges.withColumn("one", F.lit(1)).join(heaviest.withColumn("one", F.lit(1)), "one").drop("one")


def balance_warning(g: Hypergraph, k: int, eps: float) -> DataFrame:
    """One row: whether some vertex alone outweighs the slack of a part."""
    slack = F.floor(F.sum("w") / F.lit(k) * F.lit(eps)).cast("long")
    return g.verts.agg(F.max("w").alias("max_vertex"), slack.alias("slack")).select("max_vertex", "slack", (F.col("max_vertex") > F.col("slack")).alias("warning"))


def edge_lengths(g: Hypergraph) -> DataFrame:
    """(e, w, len) of hyperedges with a pin."""
    return g.pins.groupBy("e").agg(F.count("*").alias("len")).join(g.hedges, "e").select("e", "w", "len")


def graph_totals(g: Hypergraph) -> DataFrame:
    """One row of counts, total weights, the longest hyperedge and average degree and size."""
    verts = g.verts.agg(F.count("*").alias("n_verts"), _long(F.sum("w")).alias("vertex_weight")).withColumn("one", F.lit(1))
    edges = edge_lengths(g).agg(F.count("*").alias("n_edges"), _long(F.sum("len")).alias("n_pins"), _long(F.max("len")).alias("max_len"), _long(F.sum("w")).alias("edge_weight")).withColumn("one", F.lit(1))
    ratios = [(F.col("n_pins") / F.col("n_verts")).alias("avg_degree"), (F.col("n_pins") / F.col("n_edges")).alias("avg_edge_size")]
    return verts.join(edges, "one").drop("one").select("*", *ratios)


def running(rows: DataFrame, order: str, weight: str) -> DataFrame:
    """(order, cum_before, weight): weights summed per distinct value, and the sum of all smaller values' weights.

    Lengths and weights take few values, so the ordered window is over the
    histogram and never over the rows.
    """
    each = rows.groupBy(order).agg(F.sum(weight).alias("weight"))
    before = F.sum("weight").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return each.select(order, F.coalesce(before, F.lit(0)).alias("cum_before"), "weight")


def weighted_percentiles(rows: DataFrame, value: str, weight: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """One row: weighted average, maximum and percentiles.

    A percentile is the value of the first row, in ascending order, before which
    more than that share of the weight lies; the maximum where there is none.
    Within a value, only its last row matters, and it has the value's other rows before it.
    """
    lightest = rows.groupBy(value).agg(F.sum(weight).alias("weight"), F.min(weight).alias("least"))
    order = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cum = lightest.select(value, F.coalesce(F.sum("weight").over(order), F.lit(0)).alias("cum_before"), "weight", "least")
    total = cum.agg(F.sum("weight").alias("total")).withColumn("one", F.lit(1))
    rows_ = cum.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    # rows of one value are taken heaviest first, so its last row is its lightest
    last = F.col("cum_before") + F.col("weight") - F.col("least")
    points = [F.coalesce(F.min(F.when(last > F.lit(p) * F.col("total") / 100, F.col(value))), F.max(value)).cast("long").alias(f"p{p}") for p in percents]
    average = (F.sum(F.col(value) * F.col("weight")) / F.max("total")).alias("avg")
    return rows_.agg(average, F.max(value).cast("long").alias("max"), *points)


def edge_len_percentiles(g: Hypergraph, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    return weighted_percentiles(edge_lengths(g), "len", "w", percents)


def vertex_weight_percentiles(g: Hypergraph, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Percentiles of vertex weights, each vertex counting by its weight."""
    return weighted_percentiles(g.verts.withColumn("share", F.col("w")), "w", "share", percents)


def describe(g: Hypergraph, drop_singletons: bool = False, matrix_rows: DataFrame | None = None) -> DataFrame:
    """Totals and percentiles together; ``matrix_rows`` (row, col) adds the number of rows without a diagonal entry."""
    from pinweave.operators.filters import drop_singletons as longer

    g = longer(g) if drop_singletons else g
    percents = (25, 50, 75, 90, 95)
    lens = edge_len_percentiles(g, percents).select(*[F.col(c).alias(f"len_{c}") for c in ["avg", "max", *[f"p{p}" for p in percents]]], F.lit(1).alias("one"))
    weights = vertex_weight_percentiles(g, percents).select(*[F.col(c).alias(f"weight_{c}") for c in ["avg", "max", *[f"p{p}" for p in percents]]], F.lit(1).alias("one"))
    out = graph_totals(g).withColumn("one", F.lit(1)).join(lens, "one").join(weights, "one")
    if matrix_rows is not None:
        missing = matrix_rows.groupBy("row").agg(F.max((F.col("row") == F.col("col")).cast("int")).alias("has")).agg(F.sum(1 - F.col("has")).alias("zero_diagonals"))
        out = out.join(missing.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def vertex_neighbour_parts(g: Hypergraph, parts: DataFrame) -> DataFrame:
    """(v, part): every part that a hyperedge of the vertex touches."""
    return g.pins.join(edge_part_counts(g, parts).select("e", "part"), "e").select("v", "part").distinct()


def move_gains(g: Hypergraph, parts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(v, src, dst, gain): what the k-1 cut loses when a vertex moves to a part it touches.

    Gain = weight of hyperedges it alone holds in its part, minus that of its
    hyperedges that don't reach the target. The latter is its degree minus those
    that do, so only (hyperedge, part) counts are joined to pins. ``counts`` are
    these, if they are known.
    """
    counts = edge_part_counts(g, parts) if counts is None else counts.select("e", "part", "cnt")
    touching = g.pins.join(parts.withColumnRenamed("part", "src"), "v").join(g.hedges, "e").join(counts, "e")
    alone = F.when((F.col("part") == F.col("src")) & (F.col("cnt") == 1), F.col("w")).otherwise(0)
    by_part = touching.groupBy("v", "src", "part").agg(F.sum("w").alias("reach"), F.sum(alone).alias("alone"))
    here = F.col("part") == F.col("src")
    # a vertex touches k parts at most
    each = by_part.groupBy("v", "src").agg(F.max(F.when(here, F.col("alone") - F.col("reach"))).alias("stays"), F.collect_list(F.when(~here, F.struct("part", "reach"))).alias("to"))
    return each.select("v", "src", "stays", F.explode("to").alias("t")).select("v", "src", F.col("t.part").alias("dst"), (F.col("stays") + F.col("t.reach")).alias("gain"))


def cap_of(g: Hypergraph, k: int, eps: float) -> tuple[int, int]:
    """(part cap, vertex cap)."""
    total = g.verts.agg(F.sum("w")).first()[0] or 0
    return part_cap(total, k, eps), vertex_cap(total, k, eps)
