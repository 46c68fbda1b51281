import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinweave.llm import op11_fill_in_middle, op12_embedding_whitening, op13_nearest_neighbours
from tests.conftest import SF

NAN, INF = float("nan"), float("inf")


def _starts(text, unit):
    blank = "\t\n\v\f\r "
    begins = {"char": lambda a, b: True, "word": lambda a, b: a in blank and b not in blank, "line": lambda a, b: a == "\n"}[unit]
    return [i for i in range(len(text)) if i == 0 or begins(text[i - 1], text[i])]


def _expected(doc_id, text, unit):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    at = [*_starts(text, unit), len(text)]
    n = len(at) - 1
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b, c = text[: at[low]], text[at[low] : at[high]], text[at[high] :]
    if h4 % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", low, high - low, f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("chunk", [7, 64, 1 << 18])
def test_cuts_against_plain_strings(spark, unit, chunk):
    texts = [None, "", "a", "é", " \n ", "<P> has a mark", "<<S", "x<M", "naïve 𝔘nits\nover  two lines\n", "über\n\n" * 30, "日本語 テキスト " * 40, "word " * 100, "word " * 100, "<" * 50, "a\x00b c"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(11, "word " * 100), (200, "<S" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("n", F.lit(1))
    out = op11_fill_in_middle.rearrange(docs, unit=unit, chunk=chunk)
    back = out.withColumn("back", op11_fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in back), key=key) == sorted((_expected(i, t, unit) for i, t in rows), key=key)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)


def test_middle_of_nothing_and_of_odd_rows(spark, odd, none):
    assert op11_fill_in_middle.rearrange(none).count() == 0
    assert op11_fill_in_middle.rearrange(odd).count() == odd.count()


def test_middle_matches_its_sql(compare):
    compare("op11_fill_in_middle")


def _vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


ODD = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [3.0, 1.0]), (1, [3.0, 5.0]), (None, [3.0, 6.0]), (2, []), (3, None), (4, [NAN, 1.0]), (5, [None, 1.0]), (60, [1.0, 2.0, 3.0]), (7, [-INF, 0.0]), (40, [0.0, 0.0])]


@pytest.mark.parametrize("parts", [1, 23])
def test_whitening_against_brute_force(spark, parts):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(parts)
    rows = op12_embedding_whitening.whiten(table).toPandas().sort_values(["vec_id", "component"])
    given = table.toPandas().sort_values("vec_id")
    x = np.floor(1024 * np.stack(given.embedding).astype(float)).astype(int) + 100000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = centred @ u / np.sqrt(e)
    got = rows.whitened.to_numpy().reshape(n, 8)
    sign = np.sign((got * want).sum(0))
    assert np.abs(got - sign * want).max() < 1e-8
    assert (rows.deviation.to_numpy().reshape(n, 8) == ((n * x - sums) ** 2).sum(1)[:, None]).all()
    assert np.allclose(rows.explained.to_numpy().reshape(n, 8), e / np.trace(centred.T @ centred / n), rtol=1e-10)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.max() < 1e-9 and (rows.n == n).all()


def test_merges_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (90, 12)) + 100000
    whole = op12_embedding_whitening.Summary.of(x)
    cut = [op12_embedding_whitening.Summary.of(y) for y in np.split(x, [1, 5, 40])]
    merged = cut[0].merge(cut[1]).merge(cut[2].merge(cut[3]))
    assert merged.n == 90 and merged.sums == whole.sums and len(merged.singular) == 12
    assert np.allclose(merged.singular, whole.singular, rtol=1e-12)
    assert np.allclose(np.abs((merged.vectors * whole.vectors).sum(1)), 1, atol=1e-9)


def test_whitening_of_odd_vectors(spark):
    rows = op12_embedding_whitening.whiten(_vectors(spark, ODD + [(9, [2.0**41, 0.0])]).withColumn("n", F.lit(1))).collect()
    assert sorted((r.vec_id for r in rows if r.vec_id is not None and r.component == 1)) == [0, 0, 1, 20, 40, 60]
    assert {r.n for r in rows if r.vec_id == 60} == {1} and all(r.whitened is None for r in rows if r.vec_id == 60)
    assert {r.n for r in rows if r.vec_id == 1} == {6} and all(r.whitened is not None and r.identity_error < 1e-9 for r in rows if r.vec_id == 1)
    flat = op12_embedding_whitening.whiten(_vectors(spark, [(i, [float(i % 2), 1.0]) for i in range(4)])).collect()
    assert {r.whitened for r in flat if r.component == 2} == {None} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in flat if r.component == 1)
    assert op12_embedding_whitening.whiten(_vectors(spark, [])).count() == 0


@pytest.mark.parametrize("wide, deviation", [(4e6, None), (2.9e6, 2_969_600_000**2), (2.0**30, None)])
def test_deviation_of_wide_sums(spark, wide, deviation):
    rows = op12_embedding_whitening.whiten(_vectors(spark, [(1, [0.0, 0.0]), (2, [wide, 0.0])])).collect()
    assert {r.deviation for r in rows} == {deviation} and len(rows) == 4


def _recall(found, ids, x, k=20):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r)
    right = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(1)
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -score[others]))][:k]
        own = sorted(got[ids[i]], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, min(k, len(others)) + 1))
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 * max(1, abs(r.score)) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        right += len({r.vec_id for r in own} & set(ids[best].tolist()))
        total += len(best)
    return right / total


@pytest.mark.parametrize("case", ["table", "unlike norms", "cone", "clusters", "few"])
def test_neighbours_recall(spark, case, monkeypatch):
    monkeypatch.setattr(op13_nearest_neighbours, "TILE", 300)
    rng = np.random.default_rng(4)
    if case == "table":
        given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
        ids, x = given.vec_id.to_numpy(), np.stack(given.embedding).astype(float)
    else:
        x = {"unlike norms": lambda: rng.standard_normal((1500, 24)) * np.exp(rng.standard_normal((1500, 1))), "cone": lambda: rng.standard_normal((1500, 32)) + 4, "clusters": lambda: np.repeat(rng.standard_normal((30, 40)), 50, 0) + rng.standard_normal((1500, 40)) * 0.05, "few": lambda: rng.standard_normal((15, 8))}[case]()
        ids = np.arange(len(x))
    found = op13_nearest_neighbours.nearest(_vectors(spark, [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)])).collect()
    assert _recall(found, ids, x) >= (1.0 if case == "few" else 0.93)


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    code, asked = (rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64(0x1F1F1F1F1F1F1F) for n in (400, 30))
    apart = np.bitwise_count(asked[:, None] ^ code[None])
    index = op13_nearest_neighbours.Index(code, 53)
    for radius in (0, 3, 7, 12, 20, 53):
        assert (index.within(asked, radius) == (apart <= radius)).all()


def test_neighbours_of_odd_vectors(spark):
    rows = [*ODD, (8, [1e200, 0.0]), (20, [1.0, 0.0]), (11, [3.0, 5.0])]
    found = op13_nearest_neighbours.nearest(_vectors(spark, rows).withColumn("rank", F.lit(1))).orderBy("query_id", "rank", "score").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found if r.query_id == 0] == [(1, 8, 1e200), (2, 1, 13.0), (3, 11, 13.0), (4, 20, 5.0), (5, 20, 1.0)]
    assert len([r for r in found if r.query_id == 20]) == 10 and not [r for r in found if r.query_id in (40, 60)]
    assert op13_nearest_neighbours.nearest(_vectors(spark, [])).count() == 0
    assert op13_nearest_neighbours.nearest(_vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_copies_fill_no_tile(spark, monkeypatch):
    """Copies of a vector under many ids, and of one row: ties go by id, and the query's own id is never among its answers."""
    monkeypatch.setattr(op13_nearest_neighbours, "TILE", 64)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8).tolist()
    rows = [(i, base) for i in range(200)] + [(0, base)] * 300 + [(1000 + i, rng.standard_normal(8).tolist()) for i in range(200)]
    found = op13_nearest_neighbours.nearest(_vectors(spark, rows)).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in found if r.query_id == 20] == [0] * 20
