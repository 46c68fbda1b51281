"""Hypergraphs and sparse matrices as text: hMeTiS, PaToH, Sandia, Matrix Market, Harwell-Boeing, DIMACS.

Readers give hypergraphs with vertices 0..V-1 and hyperedges 0..E-1. Headers
are small and read by the driver; the rest are DataFrame operations on numbered
lines. Writers give (n, value) lines, and ``save`` writes them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.functions.scalars import numbers
from pinweave.operators.contract import clique_edges, column_net, fine_grain
from pinweave.operators.model import Hypergraph
from pinweave.sources.lines import dense_ids, numbered_lines
from pinweave.storage import settled


def _tokens(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.regexp_replace(value, "%.*", ""), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def _graph(lines: DataFrame, n_verts: int, n_edges: int, base: int, edge_weights: bool, vertex_weights: bool) -> Hypergraph:
    """From numbered lines: a header, one line per hyperedge, then vertex weights if any."""
    spark = lines.sparkSession
    rows = lines.select((F.col("n") - 1).alias("e"), _tokens(F.col("value")).alias("t"))
    edges = rows.where((F.col("e") >= 0) & (F.col("e") < n_edges))
    first = 2 if edge_weights else 1
    pins = edges.select("e", F.explode(F.slice("t", first, F.greatest(F.size("t"), F.lit(first)))).alias("v")).select("e", (F.col("v") - base).alias("v")).distinct()
    hedges = edges.select("e", (F.col("t")[0] if edge_weights else F.lit(1)).cast("long").alias("w"))
    verts = spark.range(n_verts).select(F.col("id").alias("v"), F.lit(1).cast("long").alias("w"))
    if vertex_weights:
        tail = rows.where(F.col("e") >= n_edges).select((F.col("e") - n_edges).alias("line"), "t")
        # one weight a line, or several in a row: the lines before hold (weights a line) times their number
        wide = tail.agg(F.max(F.size("t"))).first()[0] or 1
        verts = tail.select("line", F.posexplode("t").alias("i", "w")).select((F.col("line") * wide + F.col("i")).alias("v"), "w").where(F.col("v") < n_verts)
    bad = pins.where((F.col("v") < 0) | (F.col("v") >= n_verts)).head(1)
    if bad:
        raise ValueError(f"pin {bad[0].v + base} of hyperedge {bad[0].e} is no vertex: there are {n_verts}")
    return Hypergraph(verts, hedges, pins)


def _header(lines: DataFrame, least: int) -> list[int]:
    row = lines.where("n = 0").first()
    found = numbers(row.value) if row else []
    if len(found) < least:
        raise ValueError(f"the header needs {least} numbers: {row.value if row else 'empty file'!r}")
    return found


def _weights_option(given: list[int]) -> int:
    """Which weights a file has: of hyperedges (1), of vertices (10) or both (11)."""
    option = given[0] if given else 0
    if option not in (0, 1, 10, 11):
        raise ValueError(f"weights option {option} is none of 0, 1, 10, 11")
    return option


def read_hmetis(spark: SparkSession, path: str) -> Hypergraph:
    """``E V [opt]``; pins from 1; opt 1 hyperedge, 10 vertex, 11 both weights."""
    lines = settled(numbered_lines(spark, path), "hmetis")
    e, v, *opt = _header(lines, 2)
    option = _weights_option(opt)
    return _graph(lines, v, e, 1, option in (1, 11), option in (10, 11))


def read_sandia(spark: SparkSession, path: str) -> Hypergraph:
    """``V E pins [opt]``; pins from 1; options as in hMeTiS."""
    lines = settled(numbered_lines(spark, path), "sandia")
    v, e, _, *opt = _header(lines, 3)
    option = _weights_option(opt)
    return _graph(lines, v, e, 1, option in (1, 11), option in (10, 11))


def read_patoh(spark: SparkSession, path: str) -> Hypergraph:
    """``base V E pins [opt [constraints]]``; opt 1 vertex, 2 hyperedge, 3 both weights; one constraint only."""
    lines = settled(numbered_lines(spark, path), "patoh")
    base, v, e, _, *rest = _header(lines, 4)
    option = rest[0] if rest else 0
    if len(rest) > 1 and rest[1] != 1:
        raise ValueError("several constraints per vertex are not supported")
    if base not in (0, 1) or option not in (0, 1, 2, 3):
        raise ValueError(f"base {base} or weights option {option} is not known")
    return _graph(lines, v, e, base, option in (2, 3), option in (1, 3))


def read_matrix_market(spark: SparkSession, path: str) -> Hypergraph:
    """A coordinate matrix's pattern: rows are vertices, columns hyperedges, all of weight 1. Values are ignored."""
    lines = settled(numbered_lines(spark, path), "matrix")
    rows, columns, _ = _header(lines, 3)[:3]
    cells = lines.where("n > 0").select(F.split(F.trim("value"), r"\s+").alias("t"))
    pins = cells.select((F.col("t")[1].cast("long") - 1).alias("e"), (F.col("t")[0].cast("long") - 1).alias("v")).distinct()
    one = F.lit(1).cast("long").alias("w")
    return Hypergraph(spark.range(rows).select(F.col("id").alias("v"), one), spark.range(columns).select(F.col("id").alias("e"), one), pins)


def harwell_boeing_entries(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """((row, col) from 0, header) of a column-compressed pattern. The header has 4 lines, 5 with right-hand sides."""
    lines = settled(numbered_lines(spark, path, comment=None), "harwell")
    top = [r.value for r in lines.where("n < 3").orderBy("n").collect()]
    if len(top) < 3:
        raise ValueError("the header needs four lines")
    counts = numbers(top[1]) + [0] * 5
    shape = numbers(top[2].strip()[3:])
    header = {"pointer_lines": counts[1], "row_lines": counts[2], "rhs_lines": counts[4], "rows": shape[0], "columns": shape[1], "nonzeros": shape[2]}
    begin = 5 if header["rhs_lines"] else 4

    def values(first: int, n: int) -> DataFrame:
        """(i, x): the numbers of some lines, counted through. All lines but the last hold equally many."""
        own = lines.where((F.col("n") >= first) & (F.col("n") < first + n)).select((F.col("n") - first).alias("line"), _tokens(F.col("value")).alias("t"))
        wide = own.agg(F.max(F.size("t"))).first()[0] or 1
        return own.select("line", F.posexplode("t").alias("i", "x")).select((F.col("line") * wide + F.col("i")).alias("i"), (F.col("x") - 1).alias("x"))

    pointers = settled(values(begin, header["pointer_lines"]), "pointers")
    if (n := pointers.count()) != header["columns"] + 1:
        raise ValueError(f"{header['columns'] + 1} column pointers are needed; there are {n}")
    ends = pointers.select((F.col("i") - 1).alias("i"), F.col("x").alias("end"))
    spans = pointers.join(ends, "i").select(F.col("i").alias("col"), F.explode_outer(F.when(F.col("end") > F.col("x"), F.sequence(F.col("x"), F.col("end") - 1))).alias("at")).where("at IS NOT NULL")
    entries = spans.join(values(begin + header["pointer_lines"], header["row_lines"]).withColumnRenamed("i", "at"), "at").select(F.col("x").alias("row"), "col")
    return settled(entries, "entries"), header


def read_harwell_boeing(spark: SparkSession, path: str, fill_diagonal: bool = False) -> Hypergraph:
    """The 1-D column-net model; ``fill_diagonal`` adds missing diagonal pins and weighs a vertex by its row's entries."""
    entries, header = harwell_boeing_entries(spark, path)
    one = F.lit(1).cast("long").alias("w")
    if not fill_diagonal:
        pins = entries.select(F.col("col").alias("e"), F.col("row").alias("v")).distinct()
        return Hypergraph(spark.range(header["rows"]).select(F.col("id").alias("v"), one), spark.range(header["columns"]).select(F.col("id").alias("e"), one), pins)
    return column_net(entries)


def read_harwell_boeing_2d(spark: SparkSession, path: str) -> Hypergraph:
    entries, header = harwell_boeing_entries(spark, path)
    return fine_grain(entries, header["columns"])


def row_counts(entries: DataFrame) -> DataFrame:
    """(row, n): entries of each row."""
    return entries.groupBy("row").agg(F.count("*").alias("n"))


def zero_weight_vertices(g: Hypergraph) -> DataFrame:
    return g.verts.where("w = 0").select("v")


def compact(g: Hypergraph) -> Hypergraph:
    """The same graph with ids 0..V-1 and 0..E-1, as files need them, as written tables."""
    v, e = dense_ids(g.verts.select("v")), dense_ids(g.hedges.select("e"))
    verts = g.verts.join(v.toDF("v", "n"), "v").select(F.col("n").alias("v"), "w")
    hedges = g.hedges.join(e.toDF("e", "n"), "e").select(F.col("n").alias("e"), "w")
    pins = g.pins.join(v.toDF("v", "nv"), "v").join(e.toDF("e", "ne"), "e").select(F.col("ne").alias("e"), F.col("nv").alias("v"))
    return Hypergraph(verts, hedges, pins).map(settled)


def _edge_lines(g: Hypergraph, base: int) -> DataFrame:
    """(n, value): weight and pins of each hyperedge, from line 1 on. A line is as long as its hyperedge, as the format wants."""
    pins = g.pins.groupBy("e").agg(F.sort_array(F.collect_list(F.col("v") + base)).alias("p"))
    return g.hedges.join(pins, "e", "left").select((F.col("e") + 1).alias("n"), F.concat_ws(" ", F.col("w").cast("string"), F.array_join(F.col("p").cast("array<string>"), " ")).alias("value"))


def _lines(g: Hypergraph, header: str, base: int) -> DataFrame:
    spark = g.verts.sparkSession
    n_edges = g.hedges.count()
    top = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(header).alias("value"))
    weights = g.verts.select((F.col("v") + n_edges + 1).alias("n"), F.col("w").cast("string").alias("value"))
    return top.unionByName(_edge_lines(g, base)).unionByName(weights)


def hmetis_lines(g: Hypergraph) -> DataFrame:
    """Lines with both kinds of weights (option 11). Ids must be dense: see ``compact``."""
    return _lines(g, f"{g.hedges.count()} {g.verts.count()} 11", 1)


def patoh_lines(g: Hypergraph) -> DataFrame:
    """Lines with base 0 and both kinds of weights (option 3)."""
    return _lines(g, f"0 {g.verts.count()} {g.hedges.count()} {g.pins.count()} 3", 0)


def sandia_lines(g: Hypergraph) -> DataFrame:
    return _lines(g, f"{g.verts.count()} {g.hedges.count()} {g.pins.count()} 11", 1)


def matrix_lines(entries: DataFrame, rows: int, columns: int) -> DataFrame:
    """Header ``cols rows nnz``, then the rows of each column from 0; an empty column is an empty line."""
    spark = entries.sparkSession
    top = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(f"{columns} {rows} {entries.count()}").alias("value"))
    own = entries.groupBy("col").agg(F.array_join(F.sort_array(F.collect_list("row")).cast("array<string>"), " ").alias("value"))
    every = spark.range(columns).select(F.col("id").alias("col")).join(own, "col", "left")
    return top.unionByName(every.select((F.col("col") + 1).alias("n"), F.coalesce("value", F.lit("")).alias("value")))


def matrix_market_lines(g: Hypergraph) -> DataFrame:
    """(n, value) of a pattern matrix; entry lines share one number, as their order is free."""
    spark = g.verts.sparkSession
    header = ["%%MatrixMarket matrix coordinate pattern general", f"{g.verts.count()} {g.hedges.count()} {g.pins.count()}"]
    top = spark.range(2).select(F.col("id").alias("n"), F.element_at(F.array(*map(F.lit, header)), (F.col("id") + 1).cast("int")).alias("value"))
    return top.unionByName(g.pins.select(F.lit(2).cast("long").alias("n"), F.concat_ws(" ", F.col("v") + 1, F.col("e") + 1).alias("value")))


def dimacs_lines(g: Hypergraph) -> DataFrame:
    """The clique-expanded graph: ``p edge V E``, then ``e a b`` from 1."""
    edges = settled(clique_edges(g), "cliques")
    spark = g.verts.sparkSession
    top = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(f"p edge {g.verts.count()} {edges.count()}").alias("value"))
    return top.unionByName(edges.select((F.col("a") + 1).alias("n"), F.concat_ws(" ", F.lit("e"), F.col("a") + 1, F.col("b") + 1).alias("value")))


def save(lines: DataFrame, path: str) -> None:
    """Write (n, value) lines in order, as a folder of files whose names sort in that order."""
    lines.orderBy("n", "value").select("value").write.text(path)
