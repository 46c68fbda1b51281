"""A hand-computed graph: six vertices of weight 1, five hyperedges, one of a single pin."""

import pytest
from pyspark.sql import functions as F

from pinweave.operators import contract as C
from pinweave.operators import filters as S
from pinweave.operators import match as M
from pinweave.operators import metrics as A
from pinweave.operators import refine as R
from pinweave.operators.model import Hypergraph, hypergraph, order_part

EDGES = {0: ([0, 1, 2], 1), 1: ([2, 3], 2), 2: ([3, 4, 5], 1), 3: ([0, 5], 1), 4: ([1], 1)}


@pytest.fixture(scope="module")
def g(spark):
    pins = spark.createDataFrame([(e, v) for e, (p, _) in EDGES.items() for v in p], "e long, v long")
    hedges = spark.createDataFrame([(e, w) for e, (_, w) in EDGES.items()], "e long, w long")
    return hypergraph(pins, spark.createDataFrame([(v, 1) for v in range(6)], "v long, w long"), hedges)


def _map(spark, values, name):
    return spark.createDataFrame(list(enumerate(values)), f"v long, {name} long")


@pytest.fixture(scope="module")
def halves(spark):
    return _map(spark, [0, 0, 0, 1, 1, 1], "part")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_schema_is_checked(g):
    with pytest.raises(ValueError):
        Hypergraph(g.verts, g.hedges, g.pins.select("v", "e"))


def test_cut_and_weights(g, halves):
    assert A.k1_cut(g, halves).first()[0] == 3
    assert A.soed(g, halves).first()[0] == 6
    assert _rows(A.part_weights(g, halves, 3)) == [(0, 3), (1, 3), (2, 0)]
    assert A.cap_of(g, 2, 0.05) == (3, 0)


def test_drop_singletons(g):
    left = S.drop_singletons(g)
    assert [r.e for r in left.hedges.orderBy("e").collect()] == [0, 1, 2, 3]
    assert left.pins.count() == 10
    totals = A.graph_totals(left).first()
    assert (totals.avg_degree, totals.avg_edge_size) == (10 / 6, 10 / 4)


@pytest.mark.parametrize("percentile, kept", [(20, [1, 3]), (50, [0, 1, 2, 3])])
def test_percentile_filter(g, percentile, kept):
    left = S.percentile_filter(S.drop_singletons(g), percentile)
    assert [r.e for r in left.hedges.orderBy("e").collect()] == kept


def test_contract_merges_equal_hyperedges(spark, g, halves):
    match = _map(spark, [0, 0, 0, 1, 1, 1], "c")
    coarse = C.contract(g, match)
    assert [r.w for r in coarse.hedges.collect()] == [3]
    assert _rows(coarse.verts) == [(0, 3), (1, 3)]
    parts = _map(spark, [0, 1], "part")
    assert A.k1_cut(coarse, parts).first()[0] == A.k1_cut(g, C.project(match, parts)).first()[0] == 3


def test_contract_keeps_unlike_hyperedges(spark, g):
    coarse = C.contract(g, _map(spark, [0, 0, 1, 2, 2, 3], "c"))
    sets = coarse.pins.groupBy("e").agg(F.sort_array(F.collect_list("v")).alias("p")).join(coarse.hedges, "e").collect()
    assert sorted((tuple(r.p), r.w) for r in sets) == [((0, 1), 1), ((0, 3), 1), ((1, 2), 2), ((2, 3), 1)]


@pytest.mark.parametrize("bits", [1, 64])
def test_equal_hyperedges_are_told_from_equal_hashes(spark, bits):
    """With hashes of one bit, unlike hyperedges of one size and ends share a group, and equal ones among them must still meet."""
    sets = [[0, 1, 9], [0, 2, 9], [0, 3, 9], [0, 1, 9], [0, 2, 9], [0, 4, 9], [0, 2, 9], [5, 6]]
    pins = spark.createDataFrame([(e, v) for e, p in enumerate(sets) for v in p], "e long, v long")
    g = hypergraph(pins)
    coarse = C.contract(g, g.verts.select("v", F.col("v").alias("c")), bits=bits)
    assert _rows(coarse.hedges) == [(0, 2), (1, 3), (2, 1), (5, 1), (7, 1)]
    assert _rows(coarse.pins.groupBy("e").count()) == [(0, 3), (1, 3), (2, 3), (5, 3), (7, 2)]


@pytest.mark.parametrize("random_replies", [False, True])
def test_match_in_an_order(g, random_replies):
    clusters = M.first_choice(g, 2, metric=2, visits="decreasing-weight", random_replies=random_replies).collect()
    assert sorted(r.v for r in clusters) == list(range(6)) and len({r.c for r in clusters}) >= 3


def test_seekers_that_one_host_turns_away(spark):
    proposals = spark.createDataFrame([(s, 100, 2, 1.0 / s) for s in range(1, 6)] + [(9, 200, 5, 1.0)], "seeker long, host long, w long, score double")
    room = spark.createDataFrame([(100, 4), (200, 4)], "host long, room long")
    assert _rows(M.replies(proposals, room, 5)) == [(1, 100), (2, 100), (3, 3), (4, 3)]


def test_scores(g):
    found = {r.u: r.score for r in M.scores(g, 2).where("v = 2").collect()}
    assert found == {0: 0.5, 1: 0.5, 3: 2.0}
    assert {r.u: r.score for r in M.scores(g, 3).where("v = 2").collect()} == {0: 0.25, 1: 0.25, 3: 1.0}
    assert M.best_matches(M.scores(g, 2)).where("v = 2").first().u == 3


@pytest.mark.parametrize("in_parts", [False, True])
def test_scores_of_tiles(spark, monkeypatch, in_parts):
    """A hyperedge in tiles scores as it does whole, and no key holds more than its tiles' pairs."""
    pins = spark.createDataFrame([(0, v) for v in range(90)] + [(1, v) for v in range(0, 90, 7)] + [(2, 3), (2, 5)], "e long, v long")
    g = hypergraph(pins)
    parts = g.verts.select("v", (F.col("v") % 2).alias("part")) if in_parts else None
    whole = _rows(M.scores(g, 2, parts))
    monkeypatch.setattr(M, "TILE", 8)
    assert _rows(M.scores(g, 2, parts)) == whole
    assert len(whole) == (90 * 89 if not in_parts else 2 * 45 * 44)
    met = M.tiled(g, A.edge_lengths(g).select("e", "len")).groupBy("e", "mine", "other").count().agg(F.max("count")).first()[0]
    assert met <= 24


def test_gain_of_a_move(g, halves):
    assert A.move_gains(g, halves).where("v = 2 AND dst = 1").first().gain == 1


@pytest.mark.parametrize("cap", [2, 3])
def test_first_choice(g, cap):
    clusters = M.first_choice(g, cap, metric=2).collect()
    assert sorted(r.v for r in clusters) == list(range(6))
    sizes = {}
    for r in clusters:
        sizes[r.c] = sizes.get(r.c, 0) + 1
    assert max(sizes.values()) <= cap


def test_restrictive_match_stays_in_parts(g, halves):
    part = [0, 0, 0, 1, 1, 1]
    assert all(part[r.v] == part[r.c] for r in M.first_choice(g, 3, metric=2, parts=halves).collect())


def test_hyperedge_match(g):
    clusters = {r.v: r.c for r in M.hyperedge_match(g, 2).collect()}
    assert clusters[2] == clusters[3] == 2


def test_refine_never_raises_the_cut(spark, g):
    start = _map(spark, [0, 1, 0, 1, 0, 1], "part")
    before = A.k1_cut(g, start).first()[0]
    parts, cut = R.refine(g, start, 2, 4)
    assert cut <= before and cut == A.k1_cut(g, parts).first()[0]
    assert A.validity(g, parts, 2, 4).first() == (True, True, True)


def test_relieve(spark, g):
    parts = R.relieve(g, _map(spark, [0, 0, 0, 0, 0, 1], "part"), 2, 3)
    assert _rows(A.part_weights(g, parts, 2)) == [(0, 3), (1, 3)]


@pytest.mark.parametrize("k", [16, 32])
def test_relieve_one_hot_part(spark, k):
    n = 100 * k
    ring = hypergraph(spark.range(n).selectExpr("id AS e", f"explode(array(id, (id + 1) % {n})) AS v"))
    parts = R.relieve(ring, spark.range(n).selectExpr("id AS v", "0L AS part"), k, 105)
    assert A.validity(ring, parts, k, 105).first() == (True, True, True)


def test_relieve_moves_what_slices_cannot(spark):
    pins = spark.createDataFrame([(0, 0), (0, 1)], "e long, v long")
    heavy = hypergraph(pins, spark.createDataFrame([(v, 5) for v in range(4)], "v long, w long"))
    parts = R.relieve(heavy, _map(spark, [0, 0, 0, 1], "part"), 2, 10)
    assert _rows(A.part_weights(heavy, parts, 2)) == [(0, 10), (1, 10)]


def test_empty_graph(spark):
    none = hypergraph(spark.createDataFrame([], "e long, v long"))
    parts = spark.createDataFrame([], "v long, part long")
    assert A.k1_cut(none, parts).first()[0] == 0
    assert C.contract(none, parts.withColumnRenamed("part", "c")).hedges.count() == 0
    assert S.percentile_filter(none, 50).hedges.count() == 0


def test_range_lookup(spark):
    keys = spark.createDataFrame([(v,) for v in range(12)], "v long")
    ranges = spark.createDataFrame([(0, 5, 0), (5, 6, 1), (6, 12, 2)], "lo long, hi long, owner long")
    assert [r.owner for r in C.range_lookup(keys, ranges, 4).orderBy("v").collect()] == [0] * 5 + [1] + [2] * 6


@pytest.mark.parametrize("metric", range(4))
def test_scores_of_seekers_and_hosts_only(g, halves, monkeypatch, metric):
    """A phase's scores are those of ``scores``, for its own pairs."""
    monkeypatch.setattr(M, "TILE", 2)
    for parts in (None, halves):
        want = {(r.v, r.u): r.score for r in M.scores(g, metric, parts).collect() if r.v % 2 and not r.u % 2}
        pairs = M.between(M._shares(g, metric, parts), metric, 6)
        seekers = g.verts.where("v % 2 = 1").select(F.col("v").alias("seeker"), "w")
        hosts = g.verts.where("v % 2 = 0").selectExpr("v AS u", "v AS host", "1L AS room", "w AS wu")
        assert {(r.seeker, r.u): r.score for r in pairs(seekers, hosts).collect()} == want != {}


@pytest.mark.parametrize("clusters", [[0, 0, 0, 3, 3, 3], [0, 1, 0, 0, 1, 1], [0, 1, 2, 3, 4, 5]])
def test_short_hyperedges_are_compared_as_lists(spark, g, monkeypatch, clusters):
    """The same coarse graph by lists of pins, by hashes and by the fallback for graphs of long hyperedges; lists take no rounds."""
    match = _map(spark, clusters, "c")
    monkeypatch.setattr(C, "SHORT", 2)
    long = C.contract(g, match)
    monkeypatch.undo()
    rounds = []
    monkeypatch.setattr(C, "settled", lambda df, name: rounds.append(name) or df)
    short = C.contract(g, match)
    assert rounds == ["merged"]
    for x, y in zip((short.verts, short.hedges, short.pins), (long.verts, long.hedges, long.pins)):
        assert _rows(x) == _rows(y)


def test_exploded_partitions_are_not_sent_to_all(spark):
    """Spark takes candidates for as few rows as vertices, so of larger tables it sent more to all tasks than a driver holds."""
    tables = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    many = order_part(tables)
    parts = many.verts.selectExpr("explode(sequence(0, 5)) AS pid", "v").selectExpr("pid", "v", "(v + pid) % 4 AS part")
    joins = [x for x in A.cuts(many, parts)._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [v#" in x]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
