"""The hypergraph: three tables of long columns.

``verts(v, w)`` vertices, ``hedges(e, w)`` hyperedges, ``pins(e, v)`` distinct
memberships. A partition is ``parts(v, part)`` or, several at once,
``parts(pid, v, part)``; a match is ``match(v, c)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hypergraph:
    verts: DataFrame
    hedges: DataFrame
    pins: DataFrame

    def __post_init__(self) -> None:
        for name, columns in (("verts", ["v", "w"]), ("hedges", ["e", "w"]), ("pins", ["e", "v"])):
            found = getattr(self, name).columns
            if found != columns:
                raise ValueError(f"{name} has columns {found}; {columns} are needed")

    def map(self, f) -> Hypergraph:
        """The same with ``f(table, name)`` applied to each table."""
        return Hypergraph(f(self.verts, "verts"), f(self.hedges, "hedges"), f(self.pins, "pins"))


def hypergraph(pins: DataFrame, verts: DataFrame | None = None, hedges: DataFrame | None = None) -> Hypergraph:
    """From memberships (repeats allowed); missing vertices or hyperedges are the pins', of weight 1."""
    pins = pins.select(F.col("e").cast("long"), F.col("v").cast("long")).distinct()
    one = F.lit(1).cast("long").alias("w")
    if verts is None:
        verts = pins.select("v").distinct().select("v", one)
    if hedges is None:
        hedges = pins.select("e").distinct().select("e", one)
    return Hypergraph(verts.select(F.col("v").cast("long"), F.col("w").cast("long")), hedges.select(F.col("e").cast("long"), F.col("w").cast("long")), pins)


def order_part(tables) -> Hypergraph:
    """Parts as vertices and orders as hyperedges, all of weight 1. ``tables(name)`` reads a table."""
    pins = tables("lineitem").select(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("v"))
    verts = tables("part").select(F.col("p_partkey").alias("v"), F.lit(1).alias("w"))
    return hypergraph(pins, verts)


def order_part_weighted(tables) -> Hypergraph:
    """The same with part sizes and the highest line number of an order as weights."""
    lines = tables("lineitem")
    pins = lines.select(F.col("l_orderkey").alias("e"), F.col("l_partkey").alias("v"))
    verts = tables("part").select(F.col("p_partkey").alias("v"), F.col("p_size").alias("w"))
    return hypergraph(pins, verts, lines.groupBy(F.col("l_orderkey").alias("e")).agg(F.max("l_linenumber").alias("w")))


def supplier_part(tables) -> Hypergraph:
    """Parts as vertices and suppliers as hyperedges, which are long."""
    pins = tables("lineitem").select(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("v"))
    return hypergraph(pins, tables("part").select(F.col("p_partkey").alias("v"), F.lit(1).alias("w")))
