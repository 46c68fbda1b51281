"""Queries over the reference tables, with DuckDB SQL that gives the same rows.

Most run on H1: parts as vertices, orders as hyperedges, both of weight 1, or
on H1w, where sizes and line numbers are weights. The deterministic partition is
``v mod 4``, the deterministic match ``v div 10``. Iterative algorithms have no
SQL; each has a query of what must hold, whose SQL is that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.operators import bisect as B
from pinweave.operators import contract as C
from pinweave.operators import filters as S
from pinweave.operators import match as M
from pinweave.operators import metrics as A
from pinweave.operators import refine as R
from pinweave.operators import shuffles as U
from pinweave.operators.model import Hypergraph, order_part, order_part_weighted, supplier_part
from pinweave.plans import control
from pinweave.plans.options import Options
from pinweave.sources import binary, text
from pinweave.storage import scratch, settled

K = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

H1 = """WITH pins AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem),
verts AS (SELECT p_partkey AS v, CAST(1 AS BIGINT) AS w FROM part),
hedges AS (SELECT DISTINCT e, CAST(1 AS BIGINT) AS w FROM pins),
parts AS (SELECT v, v % 4 AS part FROM verts),
lens AS (SELECT e, w, count(*) AS len FROM pins JOIN hedges USING (e) GROUP BY e, w),
cnt AS (SELECT e, part, count(*) AS cnt FROM pins JOIN parts USING (v) GROUP BY e, part),
lam AS (SELECT e, w, count(*) AS lam FROM cnt JOIN hedges USING (e) GROUP BY e, w)
"""
H1W = """WITH pins AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem),
verts AS (SELECT p_partkey AS v, CAST(p_size AS BIGINT) AS w FROM part),
hedges AS (SELECT l_orderkey AS e, CAST(max(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY l_orderkey),
parts AS (SELECT v, v % 4 AS part FROM verts),
lens AS (SELECT e, w, count(*) AS len FROM pins JOIN hedges USING (e) GROUP BY e, w),
cnt AS (SELECT e, part, count(*) AS cnt FROM pins JOIN parts USING (v) GROUP BY e, part),
lam AS (SELECT e, w, count(*) AS lam FROM cnt JOIN hedges USING (e) GROUP BY e, w)
"""


def _tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(build: Callable = order_part, sql: str | None = None, name: str | None = None, top: str | None = None):
    """Register a function of a hypergraph as a query."""

    def add(f: Callable[[Hypergraph], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(build(_tables(spark, sf_dir)))
        if sql is not None:
            SQL[key] = ({order_part: H1, order_part_weighted: H1W}.get(build, "") if top is None else top) + sql
        return f

    return add


def modulo(g: Hypergraph, k: int = K) -> DataFrame:
    return g.verts.select("v", (F.col("v") % k).alias("part"))


def tens(g: Hypergraph) -> DataFrame:
    return g.verts.select("v", F.floor(F.col("v") / 10).cast("long").alias("c"))


def _long(df: DataFrame) -> DataFrame:
    """Counts and sums as longs."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


# -- cuts, balance, statistics ------------------------------------------------


@_query(sql="SELECT CAST(coalesce(sum((lam - 1) * w), 0) AS BIGINT) AS k1_cut FROM lam")
def k1_cut(g):
    return A.k1_cut(g, modulo(g))


@_query(order_part_weighted, "SELECT CAST(coalesce(sum((lam - 1) * w), 0) AS BIGINT) AS k1_cut FROM lam")
def k1_cut_weighted(g):
    return A.k1_cut(g, modulo(g))


@_query(sql="SELECT CAST(coalesce(sum(CASE WHEN lam > 1 THEN lam * w END), 0) AS BIGINT) AS soed FROM lam")
def soed(g):
    return A.soed(g, modulo(g))


@_query(order_part_weighted, "SELECT p.part, CAST(coalesce(sum(w), 0) AS BIGINT) AS weight FROM range(4) AS p(part) LEFT JOIN parts ON parts.part = p.part LEFT JOIN verts USING (v) GROUP BY p.part")
def part_weights(g):
    return A.part_weights(g, modulo(g), K)


@_query(
    order_part_weighted,
    """, pw AS (SELECT part, sum(w) AS weight FROM parts JOIN verts USING (v) GROUP BY part),
one AS (SELECT sum(weight) AS total, min(weight) AS lo, max(weight) AS hi FROM pw)
SELECT CAST((SELECT sum((lam - 1) * w) FROM lam) AS BIGINT) AS k1_cut, CAST(floor(total / 4.0 * 1.05) AS BIGINT) AS max_allowed,
  CAST(lo AS BIGINT) AS min_part, CAST(hi AS BIGINT) AS max_part, hi <= floor(total / 4.0 * 1.05) AS balanced FROM one""",
)
def partition_summary(g):
    return A.partition_summary(g, modulo(g), K, 0.05)


@_query(order_part_weighted, "SELECT lam, count(*) AS n_edges, CAST(sum(w) AS BIGINT) AS weight FROM lam GROUP BY lam")
def lambda_histogram(g):
    return A.lambda_histogram(g, modulo(g))


@_query(sql="SELECT e, part, cnt FROM cnt")
def edge_part_counts(g):
    return A.edge_part_counts(g, modulo(g))


@_query(sql="SELECT DISTINCT v, part FROM pins JOIN cnt USING (e)")
def vertex_neighbour_parts(g):
    return A.vertex_neighbour_parts(g, modulo(g))


@_query(
    order_part_weighted,
    """, own AS (SELECT pins.v, parts.part AS src, sum(w) AS degree, sum(CASE WHEN cnt = 1 THEN w ELSE 0 END) AS alone
  FROM pins JOIN parts USING (v) JOIN hedges USING (e) JOIN cnt ON cnt.e = pins.e AND cnt.part = parts.part GROUP BY pins.v, parts.part),
reach AS (SELECT pins.v, cnt.part AS dst, sum(w) AS reach FROM pins JOIN cnt USING (e) JOIN hedges USING (e) GROUP BY pins.v, cnt.part)
SELECT v, src, dst, CAST(alone - degree + reach AS BIGINT) AS gain FROM own JOIN reach USING (v) WHERE src <> dst""",
)
def move_gain(g):
    return A.move_gains(g, modulo(g))


@_query(order_part_weighted, "SELECT max(w) AS max_vertex, CAST(floor(sum(w) / 4.0 * 0.05) AS BIGINT) AS slack, max(w) > floor(sum(w) / 4.0 * 0.05) AS warning FROM verts")
def balance_warning(g):
    return A.balance_warning(g, K, 0.05)


@_query(
    order_part_weighted,
    """, cap AS (SELECT floor(sum(w) / 4.0 * 1.05) AS cap FROM verts), odd AS (SELECT v, v % 5 - 1 AS part FROM verts WHERE v % 7 <> 0),
cases AS (SELECT 0 AS kind, v, part FROM parts UNION ALL SELECT 1, v, part FROM odd UNION ALL SELECT 2, v, CASE WHEN v % 3 = 0 THEN 0 ELSE v % 4 END FROM verts),
each AS (SELECT kind, v, w, count(part) AS n, min(part) AS lo, max(part) AS hi FROM (SELECT DISTINCT kind FROM cases) CROSS JOIN verts LEFT JOIN cases USING (kind, v) GROUP BY kind, v, w),
heaviest AS (SELECT kind, max(x) AS x FROM (SELECT kind, part, sum(w) AS x FROM cases JOIN verts USING (v) WHERE part BETWEEN 0 AND 3 GROUP BY kind, part) GROUP BY kind)
SELECT kind, bool_and(n = 1) AS covered, bool_and(lo >= 0 AND hi < 4) AS in_range, max(x) <= max(cap) AS balanced FROM each JOIN heaviest USING (kind) CROSS JOIN cap GROUP BY kind""",
)
def partition_validity(g):
    """A sound partition, one with vertices that have no part or one out of range, and one that is lopsided."""
    cap, _ = A.cap_of(g, K, 0.05)
    odd = g.verts.where("v % 7 <> 0").select("v", (F.col("v") % 5 - 1).alias("part"))
    lopsided = g.verts.select("v", F.when(F.col("v") % 3 == 0, 0).otherwise(F.col("v") % K).cast("long").alias("part"))
    facts = [A.validity(g, parts, K, cap).select(F.lit(i).alias("kind"), "covered", "in_range", "balanced") for i, parts in enumerate((modulo(g), odd, lopsided))]
    return facts[0].unionByName(facts[1]).unionByName(facts[2])


@_query(
    order_part_weighted,
    """SELECT (SELECT count(*) FROM verts) AS n_verts, CAST((SELECT sum(w) FROM verts) AS BIGINT) AS vertex_weight,
  count(*) AS n_edges, CAST(sum(len) AS BIGINT) AS n_pins, max(len) AS max_len, CAST(sum(w) AS BIGINT) AS edge_weight,
  sum(len) / (SELECT count(*) FROM verts) AS avg_degree, sum(len) / count(*) AS avg_edge_size FROM lens""",
)
def graph_totals(g):
    return A.graph_totals(g)


@_query(sql="SELECT round(count(*) / (SELECT count(*) FROM verts), 9) AS avg_degree FROM pins")
def avg_degree(g):
    return A.graph_totals(g).select(F.round("avg_degree", 9).alias("avg_degree"))


@_query(sql="SELECT round(count(*) / count(DISTINCT e), 9) AS avg_edge_size FROM pins")
def avg_edge_size(g):
    return A.graph_totals(g).select(F.round("avg_edge_size", 9).alias("avg_edge_size"))


_PERCENTILES = """, run AS (SELECT x, y, sum(y) OVER (ORDER BY x, y DESC, id ROWS UNBOUNDED PRECEDING) - y AS before, sum(y) OVER () AS total FROM src)
SELECT round(sum(x * y) / max(total), 9) AS avg, CAST(max(x) AS BIGINT) AS max, """ + ", ".join(f"CAST(coalesce(min(CASE WHEN before > {p} * total / 100 THEN x END), max(x)) AS BIGINT) AS p{p}" for p in A.PERCENTS) + " FROM run"


@_query(order_part_weighted, ", src AS (SELECT len AS x, w AS y, e AS id FROM lens)" + _PERCENTILES)
def edge_len_percentiles(g):
    return A.edge_len_percentiles(g).withColumn("avg", F.round("avg", 9))


@_query(order_part_weighted, ", src AS (SELECT w AS x, w AS y, v AS id FROM verts)" + _PERCENTILES)
def vertex_weight_percentiles(g):
    return A.vertex_weight_percentiles(g).withColumn("avg", F.round("avg", 9))


@_query(order_part_weighted, ", src AS (SELECT len AS x, w AS y, e AS id FROM lens WHERE len > 1)" + _PERCENTILES.replace(" AS p95", " AS p95, CAST(coalesce(min(CASE WHEN before > 90 * total / 100 THEN x END), max(x)) AS BIGINT) AS p90"))
def describe_lengths(g):
    """The printer's length figures without singletons, with the 90th percentile."""
    return A.describe(g, drop_singletons=True).select(F.round("len_avg", 9).alias("avg"), *[F.col(f"len_{c}").alias(c) for c in ("max", "p25", "p50", "p75", "p90", "p95")])


# -- filters, orders, choices -------------------------------------------------


@_query(sql="SELECT e, w FROM lens WHERE len > 1")
def drop_singletons(g):
    return S.drop_singletons(g).hedges


@_query(
    order_part_weighted,
    """, run AS (SELECT e, w, len, sum(w) OVER (ORDER BY len, w DESC, e ROWS UNBOUNDED PRECEDING) - w AS before, sum(w) OVER () AS total FROM lens)
SELECT e, w FROM lens WHERE len <= coalesce((SELECT min(len) FROM run WHERE before >= 60.0 * total / 100), 1000000000)""",
)
def percentile_filter(g):
    return S.percentile_filter(g, 60.0).hedges


@_query(sql="SELECT e, w FROM lens WHERE 2 * len < (SELECT max(len) FROM lens)")
def length_limit_filter(g):
    return S.length_limit_filter(g).hedges


def _candidates(g: Hypergraph) -> DataFrame:
    """Candidate partitions (v * a + b) mod 4; equal cuts occur."""
    pairs = [(1, 0), (1, 1), (3, 2), (2, 1), (5, 0), (7, 3)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pid"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)])).alias("c")
    return g.verts.select("v", rows).select("c.pid", "v", ((F.col("v") * F.col("c.a") + F.col("c.b")) % K).alias("part"))


_CUTS = """, cand(pid, a, b) AS (VALUES (0, 1, 0), (1, 1, 1), (2, 3, 2), (3, 2, 1), (4, 5, 0), (5, 7, 3)),
spans AS (SELECT pid, e, count(DISTINCT (v * a + b) % 4) AS lam FROM pins, cand GROUP BY pid, e),
cuts AS (SELECT pid, CAST(sum(lam - 1) AS BIGINT) AS cut, CAST(sum(CASE WHEN lam > 1 THEN lam ELSE 0 END) AS BIGINT) AS soed FROM spans GROUP BY pid)
"""


@_query(sql=_CUTS + "SELECT pid, cut, soed FROM cuts")
def candidate_cuts(g):
    return A.cuts(g, _candidates(g)).select("pid", F.col("k1_cut").alias("cut"), "soed")


@_query(
    sql=_CUTS
    + """, kept AS (SELECT min(pid) AS pid, cut FROM cuts WHERE cut <= (SELECT min(cut) + floor(min(cut) * 0.02) FROM cuts) GROUP BY cut)
SELECT pid, cut, row_number() OVER (ORDER BY pid) - 1 AS new_pid FROM kept"""
)
def prune_partitions(g):
    return S.prune_partitions(A.cuts(g, _candidates(g)).select("pid", F.col("k1_cut").alias("cut")), 0.02)


@_query(sql=_CUTS + "SELECT pid, cut FROM cuts ORDER BY cut, pid LIMIT 1")
def keep_best(g):
    return S.keep_best(A.cuts(g, _candidates(g)).select("pid", F.col("k1_cut").alias("cut")))


@_query(sql=_CUTS + "SELECT min(cut) AS best, max(cut) AS worst, round(avg(cut), 9) AS average FROM cuts")
def run_summary(g):
    return A.cuts(g, _candidates(g)).agg(F.min("k1_cut").alias("best"), F.max("k1_cut").alias("worst"), F.round(F.avg("k1_cut"), 9).alias("average"))


@_query(
    order_part_weighted,
    """SELECT v, (v * 1103515245 + 12345 + 7) % 2147483648 AS random, v AS increasing, -v AS decreasing, w AS by_weight, -w AS by_weight_desc FROM verts""",
)
def visit_orders(g):
    names = {"random": "random", "increasing": "increasing", "decreasing": "decreasing", "by_weight": "increasing-weight", "by_weight_desc": "decreasing-weight"}
    return g.verts.select("v", *[S.visit_key(how, 7).alias(name) for name, how in names.items()])


@_query(order_part_weighted, "SELECT e, w, len, len * 1000000 - w AS key FROM lens")
def hyperedge_order(g):
    """Ascending (key, e) takes short hyperedges first, and heavy before light."""
    return S.hyperedge_order(g).select("e", "w", "len", (F.col("len") * 1000000 - F.col("w")).alias("key"))


# -- scores and matches -------------------------------------------------------

_SCORES = """, score AS (SELECT a.v, b.u, round(sum({s}) / {d}, 9) AS score
  FROM pins a JOIN (SELECT e, v AS u FROM pins) b ON a.e = b.e AND a.v <> b.u JOIN lens ON lens.e = a.e
  JOIN verts x ON x.v = a.v JOIN verts y ON y.v = b.u {more} GROUP BY a.v, b.u, x.w, y.w)
"""


def _scores_sql(metric: int, more: str = "") -> str:
    return _SCORES.format(s="CAST(lens.w AS DOUBLE) / (len - 1)" if metric >= 2 else "CAST(lens.w AS DOUBLE)", d="(x.w + y.w)" if metric in (1, 3) else "1.0", more=more)


def _score_query(metric: int) -> None:
    @_query(order_part_weighted, _scores_sql(metric) + "SELECT v, u, round(score, 6) AS score FROM score", f"connectivity_score_{metric}")
    def connectivity_score(g):
        return M.scores(g, metric).select("v", "u", F.round("score", 6).alias("score"))


for _metric in range(4):
    _score_query(_metric)

_BEST = "SELECT v, u, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, u) AS n FROM score) WHERE n = 1"


@_query(order_part_weighted, _scores_sql(2) + _BEST)
def best_match(g):
    return M.best_matches(M.scores(g, 2)).withColumn("score", F.round("score", 6))


@_query(order_part_weighted, _scores_sql(2, "JOIN parts px ON px.v = a.v JOIN parts py ON py.v = b.u AND px.part = py.part") + _BEST)
def restrictive_best_match(g):
    return M.best_matches(M.scores(g, 2, modulo(g))).withColumn("score", F.round("score", 6))


@_query(
    order_part_weighted,
    _scores_sql(2)
    + """, own AS (SELECT s.v AS seeker, s.u AS host, s.score, a.w, 90 - b.w AS room FROM score s JOIN verts a ON a.v = s.v JOIN verts b ON b.v = s.u WHERE s.v % 2 = 0 AND s.u % 2 = 1 AND a.w <= 90 - b.w),
asked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seeker ORDER BY score DESC, host) AS n FROM own) WHERE n = 1),
run AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY score DESC, seeker) <= room AS taken FROM asked),
away AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY score DESC, seeker) AS upto FROM run WHERE NOT taken),
left_ AS (SELECT *, min(seeker) OVER (PARTITION BY host) AS c, count(*) OVER (PARTITION BY host) AS m FROM away WHERE upto <= 90)
SELECT seeker, host AS c, true AS accepted FROM run WHERE taken UNION ALL SELECT seeker, c, false FROM left_ WHERE m > 1""",
)
def match_requests(g):
    """One phase of requests and replies: even vertices ask their best odd neighbours, whose clusters may weigh 90; those turned away by one host join each other."""
    match = settled(g.verts.select("v", F.lit(None).cast("long").alias("c"), "w"), "match")
    proposals, room = M.requests(M.scores(g, 2), match, 90, F.col("v") % 2 == 0)
    return M.replies(settled(proposals, "proposals"), room, 90).select("seeker", "c", (F.col("c") % 2 == 1).alias("accepted"))


@_query(
    order_part_weighted,
    """, free AS (SELECT v, w AS wv FROM verts WHERE v % 3 = 0), cl AS (SELECT v, w, v // 10 AS c FROM verts WHERE v % 3 <> 0),
choice AS (SELECT * FROM (SELECT v, wv, e, len, row_number() OVER (PARTITION BY v ORDER BY len, lens.w DESC, e) AS n FROM pins JOIN free USING (v) JOIN lens USING (e) WHERE len > 1) WHERE n = 1),
alone AS (SELECT e, min(v) AS seeker, min(wv) AS w, min(len) AS len FROM choice GROUP BY e HAVING count(*) = 1),
room AS (SELECT c, 220 - sum(w) AS room FROM cl GROUP BY c),
asked AS (SELECT * FROM (SELECT a.seeker, a.w, a.len, c, room, row_number() OVER (PARTITION BY a.seeker ORDER BY room DESC, c) AS n
  FROM alone a JOIN (SELECT DISTINCT e, c FROM pins JOIN cl USING (v)) USING (e) JOIN room USING (c) WHERE a.w <= room) WHERE n = 1)
SELECT seeker AS v, c AS "to" FROM (SELECT *, sum(w) OVER (PARTITION BY c ORDER BY len, seeker) AS upto FROM asked) WHERE upto <= room""",
)
def cluster_requests(g):
    """Free vertices (those that 3 divides) that are alone in choosing their hyperedge, taken in by clusters of at most 220."""
    match = settled(g.verts.select("v", F.when(F.col("v") % 3 != 0, F.floor(F.col("v") / 10)).cast("long").alias("c"), "w"), "match")
    choice = settled(M.hyperedge_choices(g, A.edge_lengths(g).where("len > 1"), match), "choices")
    return M.cluster_requests(g, choice, match, 220)


# -- contraction and projection -----------------------------------------------

_COARSE = """, coarse AS (SELECT DISTINCT e, v // 10 AS c FROM pins),
sets AS (SELECT e, string_agg(c, ',' ORDER BY c) AS pins, count(*) AS n FROM coarse GROUP BY e HAVING count(*) > 1)
"""


@_query(order_part_weighted, _COARSE + "SELECT min(e) AS e, pins, CAST(sum(w) AS BIGINT) AS w FROM sets JOIN hedges USING (e) GROUP BY pins")
def contract_pairs(g):
    coarse = C.contract(g, tens(g))
    listed = coarse.pins.groupBy("e").agg(F.array_join(F.sort_array(F.collect_list("v")).cast("array<string>"), ",").alias("pins"))
    return coarse.hedges.join(listed, "e").select("e", "pins", "w")


@_query(order_part_weighted, "SELECT v // 10 AS v, CAST(sum(w) AS BIGINT) AS w FROM verts GROUP BY v // 10")
def coarse_vertex_weights(g):
    return C.cluster_weights(g, tens(g))


@_query(sql="SELECT v, (v // 10) % 4 AS part FROM verts")
def project_partition(g):
    coarse = C.cluster_weights(g, tens(g)).select("v", (F.col("v") % K).alias("part"))
    return C.project(tens(g), coarse)


@_query(order_part_weighted, _COARSE + "SELECT true AS same_cut, CAST((SELECT sum(w) FROM verts) AS BIGINT) AS weight FROM (SELECT 1)")
def contraction_invariants(g):
    """The cut of a coarse partition is its projection's, and contraction keeps all weight."""
    match = tens(g)
    coarse = C.contract(g, match)
    parts = coarse.verts.select("v", (F.col("v") % K).alias("part"))
    a = A.k1_cut(coarse, parts).select(F.col("k1_cut").alias("a"), F.lit(1).alias("one"))
    b = A.k1_cut(g, C.project(match, parts)).select(F.col("k1_cut").alias("b"), F.lit(1).alias("one"))
    weight = coarse.verts.agg(F.sum("w").alias("weight")).withColumn("one", F.lit(1))
    return a.join(b, "one").join(weight, "one").select((F.col("a") == F.col("b")).alias("same_cut"), "weight")


@_query(sql="SELECT v, (v // 10) // 10 AS c FROM verts")
def compose_maps(g):
    coarse = C.cluster_weights(g, tens(g))
    return C.compose(tens(g), coarse.select("v", F.floor(F.col("v") / 10).cast("long").alias("c")))


@_query(sql=", s AS (SELECT e, v FROM pins JOIN parts USING (v) WHERE part = 1) SELECT e, v FROM s WHERE e IN (SELECT e FROM s GROUP BY e HAVING count(*) > 1)")
def bisect_split(g):
    return C.side(g, modulo(g), 1).pins


@_query(sql="SELECT DISTINCT a.v AS a, b.v AS b FROM pins a JOIN pins b ON a.e = b.e AND a.v < b.v")
def clique_edges(g):
    return C.clique_edges(g)


@_query(sql="SELECT v, count(*) AS degree, CAST(sum(e) AS BIGINT) AS edges_sum, min(e) AS first_edge, max(e) AS last_edge FROM pins GROUP BY v")
def inverse_index(g):
    return _long(g.pins.groupBy("v").agg(F.count("*").alias("degree"), F.sum("e").alias("edges_sum"), F.min("e").alias("first_edge"), F.max("e").alias("last_edge")))


@_query(sql="SELECT v, least(v // ((SELECT count(*) FROM verts) // 7), 6) AS owner FROM verts")
def block_owner_range_join(g):
    n = g.verts.count()
    size = max(1, n // 7)
    blocks = g.verts.sparkSession.range(7).select((F.col("id") * size).alias("lo"), F.when(F.col("id") == 6, F.lit(1 << 40)).otherwise((F.col("id") + 1) * size).alias("hi"), F.col("id").alias("owner"))
    bounded = blocks.withColumn("hi", F.least("hi", F.lit(max(n, 7 * size))))
    return C.range_lookup(g.verts.select("v"), bounded, size)


@_query(sql="SELECT v, ((v * 1103515245 + 12345 + 3) % 2147483648) // 7 % 5 AS target, row_number() OVER (PARTITION BY ((v * 1103515245 + 12345 + 3) % 2147483648) // 7 % 5 ORDER BY v) - 1 AS n FROM verts")
def random_shuffle(g):
    return U.numbered(U.dealt(U.shuffled(g, 5, 3)))


@_query(
    order_part_weighted,
    """, loose AS (SELECT v, w FROM verts WHERE v % 5 = 0), kept AS (SELECT v, w, v % 3 AS part FROM verts WHERE v % 5 <> 0),
room AS (SELECT p.part, greatest(0, (SELECT floor(sum(w) / 4.0 * 1.05) FROM verts) - coalesce(sum(w), 0)) AS room FROM range(4) AS p(part) LEFT JOIN kept ON kept.part = p.part GROUP BY p.part),
stretch AS (SELECT part, sum(room) OVER (ORDER BY part) AS upto, sum(room) OVER () AS total FROM room),
line AS (SELECT v, sum(w) OVER (ORDER BY w DESC, v) - w AS at, (SELECT sum(w) FROM loose) AS weight FROM loose)
SELECT v, part FROM kept UNION ALL SELECT v, least(3, (SELECT count(*) FROM stretch WHERE upto * line.weight <= line.at * total)) FROM line""",
)
def isolated_fill(g):
    """Vertices without a hyperedge (here those that 5 divides) dealt into the room that the others' parts leave."""
    cap, _ = A.cap_of(g, K, 0.05)
    parts = g.verts.where("v % 5 <> 0").select("v", (F.col("v") % 3).alias("part"))
    return U.filled(g, parts, K, cap)


@_query(sql="SELECT v, part // 2 AS target, row_number() OVER (PARTITION BY part // 2 ORDER BY v) - 1 AS n FROM parts")
def shuffle_by_partition(g):
    return U.numbered(U.dealt(U.by_part(modulo(g), K, 2)))


# -- matrices and files -------------------------------------------------------

_CELLS = "WITH cells AS (SELECT DISTINCT l_partkey AS r, l_suppkey AS c FROM lineitem)\n"


def _cells(g: Hypergraph) -> DataFrame:
    return g.pins.select(F.col("v").alias("row"), F.col("e").alias("col"))


@_query(
    supplier_part,
    """, lines AS (SELECT r AS i FROM cells UNION SELECT c FROM cells),
every AS (SELECT r, c, 1 AS w FROM cells UNION ALL SELECT i, i, 0 FROM lines WHERE (i, i) NOT IN (SELECT (r, c) FROM cells)),
pins AS (SELECT c AS e, w FROM every UNION ALL SELECT r + 1000000 AS e, w FROM every)
SELECT e, count(*) AS pins, CAST(sum(w) AS BIGINT) AS weight FROM pins GROUP BY e""",
    top=_CELLS,
)
def fine_grain_2d(g):
    """Hyperedges of the 2-D model of the part-supplier matrix, with pins and the weight of their vertices."""
    model = C.fine_grain(_cells(g), 1_000_000)
    return model.pins.join(model.verts, "v").groupBy("e").agg(F.count("*").alias("pins"), F.sum("w").alias("weight"))


@_query(
    supplier_part,
    """, pins AS (SELECT c AS e, r AS v FROM cells UNION SELECT c, c FROM cells)
SELECT v, count(*) AS degree, coalesce((SELECT count(*) FROM cells WHERE r = v), 0) AS w FROM pins GROUP BY v""",
    top=_CELLS,
)
def matrix_diagonal_model(g):
    model = C.column_net(_cells(g))
    return model.pins.groupBy("v").agg(F.count("*").alias("degree")).join(model.verts, "v")


@_query(supplier_part, "SELECT r AS row, count(*) AS n FROM cells GROUP BY r", top=_CELLS)
def matrix_row_counts(g):
    return text.row_counts(_cells(g))


_DENSE = """, dv AS (SELECT v, w, row_number() OVER (ORDER BY v) - 1 AS n FROM verts), de AS (SELECT e, w, row_number() OVER (ORDER BY e) - 1 AS n FROM hedges),
dp AS (SELECT de.n AS e, de.w, dv.n AS v FROM pins JOIN dv USING (v) JOIN de USING (e))
"""


@_query(
    order_part_weighted,
    _DENSE
    + """SELECT 0 AS n, (SELECT count(*) FROM hedges) || ' ' || (SELECT count(*) FROM verts) || ' 11' AS value
UNION ALL SELECT e + 1, w || ' ' || string_agg(v + 1, ' ' ORDER BY v) FROM dp GROUP BY e, w
UNION ALL SELECT n + (SELECT count(*) FROM hedges) + 1, CAST(w AS VARCHAR) FROM dv""",
)
def hmetis_lines(g):
    return text.hmetis_lines(text.compact(g))


@_query(
    order_part_weighted,
    _DENSE
    + """SELECT 0 AS n, '0 ' || (SELECT count(*) FROM verts) || ' ' || (SELECT count(*) FROM hedges) || ' ' || (SELECT count(*) FROM pins) || ' 3' AS value
UNION ALL SELECT e + 1, w || ' ' || string_agg(v, ' ' ORDER BY v) FROM dp GROUP BY e, w
UNION ALL SELECT n + (SELECT count(*) FROM hedges) + 1, CAST(w AS VARCHAR) FROM dv""",
)
def patoh_lines(g):
    return text.patoh_lines(text.compact(g))


@_query(
    sql=_DENSE
    + """SELECT CAST(0 AS BIGINT) AS n, '%%MatrixMarket matrix coordinate pattern general' AS value
UNION ALL SELECT 1, (SELECT count(*) FROM verts) || ' ' || (SELECT count(*) FROM hedges) || ' ' || (SELECT count(*) FROM pins)
UNION ALL SELECT 2, (v + 1) || ' ' || (e + 1) FROM dp"""
)
def matrix_market_lines(g):
    return text.matrix_market_lines(text.compact(g))


@_query(
    sql=_DENSE
    + """, ce AS (SELECT DISTINCT a.v AS a, b.v AS b FROM dp a JOIN dp b ON a.e = b.e AND a.v < b.v)
SELECT CAST(0 AS BIGINT) AS n, 'p edge ' || (SELECT count(*) FROM verts) || ' ' || (SELECT count(*) FROM ce) AS value
UNION ALL SELECT a + 1, 'e ' || (a + 1) || ' ' || (b + 1) FROM ce"""
)
def dimacs_lines(g):
    return text.dimacs_lines(text.compact(g))


@_query(
    supplier_part,
    """SELECT CAST(0 AS BIGINT) AS n, (max(c) + 1) || ' ' || (max(r) + 1) || ' ' || count(*) AS value FROM cells
UNION ALL SELECT i + 1, coalesce(string_agg(r, ' ' ORDER BY r), '') FROM range((SELECT max(c) + 1 FROM cells)) AS t(i) LEFT JOIN cells ON c = i GROUP BY i""",
    top=_CELLS,
)
def matrix_text_lines(g):
    cells = settled(_cells(g))
    most = cells.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    return text.matrix_lines(cells, most.row + 1, most.col + 1)


# Files are written to the shared folder and read back; hyperedges of one content are counted, as binary files don't keep their ids.
_SHAPE = _DENSE + """, ds AS (SELECT e, w, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM dp GROUP BY e, w)
SELECT 'e' AS kind, n, total, w, count(*) AS times FROM ds WHERE n >= {least} GROUP BY n, total, w
UNION ALL SELECT 'v', 1, n, w, 1 FROM dv"""


def _shape(g: Hypergraph) -> DataFrame:
    sets = g.pins.groupBy("e").agg(F.count("*").alias("n"), F.sum("v").alias("total")).join(g.hedges, "e")
    edges = sets.groupBy("n", "total", "w").agg(F.count("*").alias("times"))
    one = F.lit(1).cast("long")
    verts = g.verts.select(F.lit("v").alias("kind"), one.alias("n"), F.col("v").alias("total"), "w", one.alias("times"))
    return edges.select(F.lit("e").alias("kind"), "n", "total", "w", "times").unionByName(verts)


def _text_round_trip(name: str, lines: Callable, read: Callable, build: Callable = order_part_weighted) -> None:
    @_query(build, _SHAPE.format(least=1), f"{name}_round_trip")
    def round_trip(g):
        spark = g.verts.sparkSession
        path = scratch(spark, name)
        text.save(lines(text.compact(g)), path)
        return _shape(read(spark, path))


_text_round_trip("hmetis", text.hmetis_lines, text.read_hmetis)
_text_round_trip("patoh", text.patoh_lines, text.read_patoh)
_text_round_trip("sandia", text.sandia_lines, text.read_sandia)
_text_round_trip("matrix_market", text.matrix_market_lines, text.read_matrix_market, order_part)


@_query(order_part_weighted, _SHAPE.format(least=2))
def binary_round_trip(g):
    spark = g.verts.sparkSession
    path = scratch(spark, "graph") + "/g.bin"
    binary.write_graph(text.compact(g), path)
    return _shape(binary.read_graph(spark, path))


@_query(order_part_weighted, _SHAPE.format(least=2))
def shard_round_trip(g):
    spark = g.verts.sparkSession
    path = scratch(spark, "shards") + "/g"
    binary.write_shards(text.compact(g), path, 5)
    return _shape(binary.read_shards(spark, path))


@_query(order_part_weighted, _DENSE + "SELECT CAST(sum((lam - 1) * w) AS BIGINT) AS k1_cut FROM (SELECT e, w, count(DISTINCT v % 4) AS lam FROM dp GROUP BY e, w)")
def partition_file_cut(g):
    """A partition vector, written and scored."""
    dense, spark = text.compact(g), g.verts.sparkSession
    path = scratch(spark, "vector") + "/g.part.4"
    binary.write_vector(modulo(dense), path)
    return spark.createDataFrame([(binary.score_partition(dense, spark, path),)], "k1_cut long")


@_query(order_part_weighted, _DENSE + "SELECT n AS v, n * 7 % 5 AS target, row_number() OVER (PARTITION BY n * 7 % 5 ORDER BY n) - 1 AS n FROM dv")
def prescribed_shuffle(g):
    """Vertices where a written vector prescribes."""
    dense, spark = text.compact(g), g.verts.sparkSession
    path = scratch(spark, "vector") + "/g.part.5"
    binary.write_vector(dense.verts.select("v", (F.col("v") * 7 % 5).alias("part")), path)
    return U.numbered(U.dealt(U.prescribed(dense, binary.read_partition(spark, path))))


@_query(order_part_weighted, ", src AS (SELECT w AS x, w AS y, v AS id FROM verts)" + _PERCENTILES.replace(" AS p95", " AS p95, CAST(coalesce(min(CASE WHEN before > 90 * total / 100 THEN x END), max(x)) AS BIGINT) AS p90"))
def describe_weights(g):
    """The printer's figures of vertex weights."""
    return A.describe(g).select(F.round("weight_avg", 9).alias("avg"), *[F.col(f"weight_{c}").alias(c) for c in ("max", "p25", "p50", "p75", "p90", "p95")])


@_query(supplier_part, "SELECT count(*) AS zero_diagonals FROM (SELECT r FROM cells GROUP BY r HAVING NOT bool_or(r = c))", top=_CELLS)
def zero_diagonals(g):
    return A.describe(g, matrix_rows=_cells(g)).select("zero_diagonals")


# -- iterative algorithms -----------------------------------------------------


def _cluster_facts(g: Hypergraph, match: DataFrame, cap: int) -> DataFrame:
    """One row: every vertex is in one cluster, and clusters of several stay under the cap."""
    sizes = g.verts.join(match, "v").groupBy("c").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("covered"), F.bool_and((F.col("w") <= cap) | (F.col("n") == 1)).alias("under_cap"))


def _part_facts(g: Hypergraph, parts: DataFrame, cut: int, bound: int, k: int = K) -> DataFrame:
    """One row: every vertex has a part, no part is over the cap, the cut is what its parts have, and it is no more than the bound."""
    cap, _ = A.cap_of(g, k, 0.05)
    covered = g.verts.join(parts, "v").agg(F.count("*").alias("n"))
    real = A.k1_cut(g, parts).select((F.col("k1_cut") == cut).alias("cut_holds"), F.lit(1).alias("one"))
    facts = A.validity(g, parts, k, cap).withColumn("one", F.lit(1)).join(covered.withColumn("one", F.lit(1)), "one").join(real, "one")
    return facts.select(F.col("n").alias("covered"), "in_range", "balanced", "cut_holds", F.lit(cut <= bound).alias("cut_falls"))


_CLUSTER_SQL = "SELECT count(*) AS covered, true AS under_cap FROM verts"
_PART_SQL = "SELECT count(*) AS covered, true AS in_range, true AS balanced, true AS cut_holds, true AS cut_falls FROM verts"


@_query(sql=_CLUSTER_SQL)
def first_choice_match(g):
    return _cluster_facts(g, M.first_choice(g, 8, metric=2), 8)


@_query(sql=_CLUSTER_SQL)
def hyperedge_match(g):
    return _cluster_facts(g, M.hyperedge_match(g, 8), 8)


@_query(sql="SELECT count(*) AS covered, true AS under_cap, true AS inside FROM verts")
def restrictive_match(g):
    match = settled(M.first_choice(g, 8, metric=2, parts=modulo(g)))
    inside = match.join(modulo(g), "v").groupBy("c").agg((F.countDistinct("part") == 1).alias("x")).agg(F.bool_and("x").alias("inside"))
    return _cluster_facts(g, match, 8).withColumn("one", F.lit(1)).join(inside.withColumn("one", F.lit(1)), "one").drop("one")


def _across(g: Hypergraph, k: int) -> tuple[list[Hypergraph], list[DataFrame]]:
    """The levels of g and the matches between them, by default options."""
    levels, matches, _ = control._downwards(control.settle(S.drop_singletons(control.settle(g))), k, Options({"number-of-parts": k}), None, control.coarsen_once)
    return levels, matches


@_query(sql=", w AS (SELECT CAST(sum(w) AS BIGINT) AS weight FROM verts) SELECT weight, true AS in_range, true AS balanced, true AS cut_falls FROM w")
def initial_bisection(g):
    """Two halves of the coarsest graph: even as vertices allow, and a cut 2 % below that of halving by number."""
    coarse = _across(g, 2)[0][-1]
    total, heaviest = coarse.verts.agg(F.sum("w"), F.max("w")).first()
    cap = max(total * 525 // 1000, (total + 1) // 2 + heaviest // 2)
    whole = coarse.verts.select(F.lit(0).alias("pid"), "v", F.lit(0).cast("long").alias("part"))
    halves = settled(B.split(coarse, whole, cap, 0.0, last=True, tries=10, seed=1).select("v", "part"))
    order = coarse.verts.select("v", (F.col("v") % 2).alias("part"))
    falls = A.k1_cut(coarse, halves).first()[0] <= 0.98 * A.k1_cut(coarse, order).first()[0]
    weights = [r.weight for r in A.part_weights(coarse, halves, 2).collect()]
    return g.verts.sparkSession.createDataFrame([(sum(weights), weights[0] + weights[1] == total, max(weights) <= cap, falls)], "weight long, in_range boolean, balanced boolean, cut_falls boolean")


def _planted(g: Hypergraph) -> Hypergraph:
    """Every hyperedge of g, held within one half of the vertices: pins of odd number move beside their hyperedge's even ones, and one in 50 hyperedges spans both."""
    side = g.pins.groupBy("e").agg(F.min("v").alias("first")).selectExpr("e", "first % 2 AS side", "pmod(e, 50) = 0 AS both")
    pins = g.pins.join(side, "e").selectExpr("e", "CASE WHEN both THEN v ELSE v - pmod(v, 2) + side END AS v").distinct()
    return Hypergraph(g.verts, g.hedges, pins.join(g.verts, "v", "left_semi").select("e", "v"))


@_query(sql="SELECT count(*) AS covered, true AS in_range, true AS balanced, true AS found FROM verts")
def planted_halves(g):
    """A graph of two halves that one hyperedge in 50 at most spans: bisection cuts no more than those."""
    g = control.settle(S.drop_singletons(_planted(g)))
    cap, _ = A.cap_of(g, 2, 0.05)
    state = B.recursive_bisection(g, 2, 0.05, tries=4)
    planted = A.k1_cut(g, g.verts.select("v", (F.col("v") % 2).alias("part"))).first()[0]
    parts = state.parts.select("v", "part")
    facts = A.validity(g, parts, 2, cap).select("covered", "in_range", "balanced").first()
    n = parts.count()
    return g.verts.sparkSession.createDataFrame([(n, facts.covered and facts.in_range, facts.balanced, state.cuts[0] <= planted)], "covered long, in_range boolean, balanced boolean, found boolean")


@_query(sql=_PART_SQL)
def recursive_bisection(g):
    """Eight parts of the coarsest graph, carried to the vertices: all within the cap, and 5 % below what dealing out by number cuts."""
    levels, matches = _across(g, 8)
    state = B.recursive_bisection(levels[-1], 8, 0.05, runs=2)
    best = min(state.cuts, key=lambda p: (state.cuts[p], p))
    parts = state.parts.where(F.col("pid") == best).select("v", "part")
    for match in reversed(matches):
        parts = settled(C.project(match, parts))
    bound = A.k1_cut(g, modulo(g, 8)).first()[0]
    return _part_facts(g, parts, state.cuts[best], int(0.95 * bound), 8)


@_query(sql=_PART_SQL)
def kway_refine(g):
    """Refined to the last gain: at least 15 % below where it began."""
    g = control.settle(g)
    start = settled(modulo(g))
    cap, _ = A.cap_of(g, K, 0.05)
    bound = A.k1_cut(g, start).first()[0]
    parts, cut = R.refine(g, start, K, cap)
    return _part_facts(g, parts, cut, int(0.85 * bound))


# Moves of every vertex to part 0, in sets by where they come from and a hash, and those that go back until part 0 is at its cap again.
@_query(
    order_part_weighted,
    """, moves AS (SELECT part AS src, v % 7 AS slice, (v * 31 + 7) % 11 AS gain, w FROM parts JOIN verts USING (v) WHERE part <> 0 AND v % 3 <> 0),
sets AS (SELECT src, slice, CAST(sum(gain) AS BIGINT) AS gain, CAST(sum(w) AS BIGINT) AS weight, count(*) AS moves FROM moves GROUP BY src, slice),
now AS (SELECT (SELECT sum(w) FROM parts JOIN verts USING (v) WHERE part = 0) + (SELECT sum(weight) FROM sets) AS w, (SELECT floor(sum(w) / 4.0 * 1.05) FROM verts) AS cap),
run AS (SELECT *, sum(weight) OVER (ORDER BY gain, slice, src) - weight AS before FROM sets)
SELECT src, slice, gain, weight, moves, (SELECT w - cap FROM now) > before AS undone FROM run""",
)
def movement_ledger(g):
    """Recorded moves as sets, and which of them balance takes back: least gain first, until the part is within its cap."""
    parts = modulo(g).join(g.verts, "v")
    recorded = parts.where("part <> 0 AND v % 3 <> 0").selectExpr("0 AS pid", "v", "w", "part AS src", "0L AS dst", "(v * 31 + 7) % 11 AS gain", "v % 7 AS slice")
    sets = settled(R.ledger(recorded), "ledger")
    cap, _ = A.cap_of(g, K, 0.05)
    weights = {r.part: r.weight for r in A.part_weights(g, modulo(g), K).collect()}  # K rows
    # other parts only lose weight, and may hold all that comes back
    back, _ = R.undone([(r.src, r.dst, r.slice, r.gain, r.weight) for r in sets.collect()], weights, {0: cap} | {p: w for p, w in weights.items() if p})
    taken = F.array(*[F.struct(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("slice")) for a, _, b in sorted(back)])
    return sets.select("src", "slice", "gain", "weight", "moves", F.array_contains(taken, F.struct("src", "slice")).alias("undone"))


@_query(sql=_PART_SQL)
def balance_repair(g):
    """From nearly all vertices in one part to all parts under the cap."""
    g = control.settle(g)
    cap, _ = A.cap_of(g, K, 0.05)
    skewed = g.verts.select("v", F.when(F.col("v") % 10 < 3, 1).when(F.col("v") % 10 < 5, 2).when(F.col("v") % 10 < 7, 3).otherwise(0).cast("long").alias("part"))
    parts = settled(R.relieve(g, settled(skewed), K, cap))
    cut = A.k1_cut(g, parts).first()[0]
    return _part_facts(g, parts, cut, A.k1_cut(g, modulo(g)).first()[0])


def _controlled(g: Hypergraph, mode: str) -> DataFrame:
    """Default options: a cut a tenth below that of dealing out by number."""
    found = control.partition(g, Options({"refinement.v-cycles": mode}))
    return _part_facts(g, found.parts, found.cut, int(0.9 * A.k1_cut(g, modulo(g)).first()[0]))


@_query(sql=_PART_SQL)
def multilevel_partition(g):
    return _controlled(control.settle(g), "off")


@_query(sql=_PART_SQL)
def vcycle_final(g):
    return _controlled(control.settle(g), "final-only")


@_query(sql=_PART_SQL)
def vcycle_all(g):
    return _controlled(control.settle(g), "all")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, part): H1 in four balanced parts."""
    return control.partition(order_part(_tables(spark, sf_dir)), Options({"refinement.v-cycles": "off"})).parts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
