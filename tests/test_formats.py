import numpy as np
import pytest

from pinweave.operators.filters import drop_singletons
from pinweave.operators.model import hypergraph
from pinweave.plans.options import Options, from_ini
from pinweave.plans.run import run
from pinweave.sources import binary, text


def _file(tmp_path, content, name="x"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def _sets(g):
    pins = {}
    for r in g.pins.collect():
        pins.setdefault(r.e, []).append(r.v)
    weights = {r.e: r.w for r in g.hedges.collect()}
    return {e: (sorted(pins.get(e, [])), w) for e, w in weights.items()}


def _weights(g):
    return [r.w for r in g.verts.orderBy("v").collect()]


T6 = {0: ([0, 1, 2], 1), 1: ([2, 3], 2), 2: ([3, 4, 5], 1), 3: ([0, 5], 1), 4: ([1], 1)}


@pytest.mark.parametrize(
    "content, weights",
    [
        ("% a comment\n5 6 1\n1 1 2 3\n2 3 4\n% more\n1 4 5 6\n1 1 6\n1 2\n", [1] * 6),
        ("5 6 11\n1 1 2 3\n2 3 4\n1 4 5 6\n1 1 6\n1 2\n" + "".join(f"{w}\n" for w in range(1, 7)), [1, 2, 3, 4, 5, 6]),
    ],
)
def test_hmetis(spark, tmp_path, content, weights):
    g = text.read_hmetis(spark, _file(tmp_path, content))
    assert _sets(g) == T6 and _weights(g) == weights


@pytest.mark.parametrize("option, tail", [("", ""), (" 10", "7\n8\n")])
def test_hmetis_without_edge_weights(spark, tmp_path, option, tail):
    g = text.read_hmetis(spark, _file(tmp_path, f"2 2{option}\n1 2\n2\n{tail}"))
    assert _sets(g) == {0: ([0, 1], 1), 1: ([1], 1)} and _weights(g) == ([7, 8] if tail else [1, 1])


@pytest.mark.parametrize("base", [0, 1])
@pytest.mark.parametrize("option", [0, 1, 2, 3])
def test_patoh(spark, tmp_path, base, option):
    w = "5 " if option >= 2 else ""
    tail = "3 4 5\n" if option in (1, 3) else ""
    g = text.read_patoh(spark, _file(tmp_path, f"{base} 3 2 4 {option}\n{w}{base} {base + 1}\n{w}{base + 1} {base + 2}\n{tail}"))
    assert _sets(g) == {0: ([0, 1], 5 if w else 1), 1: ([1, 2], 5 if w else 1)}
    assert _weights(g) == ([3, 4, 5] if tail else [1, 1, 1])


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError):
        text.read_patoh(spark, _file(tmp_path, "0 3 2 4 1 2\n0 1\n1 2\n", "a"))
    with pytest.raises(ValueError):
        text.read_hmetis(spark, _file(tmp_path, "1 2\n1 3\n", "b"))
    with pytest.raises(ValueError):
        text.read_hmetis(spark, _file(tmp_path, "", "c"))


@pytest.mark.parametrize("lines, read", [(text.hmetis_lines, text.read_hmetis), (text.patoh_lines, text.read_patoh), (text.sandia_lines, text.read_sandia)])
def test_text_round_trips(spark, tmp_path, lines, read):
    g = text.read_hmetis(spark, _file(tmp_path, "5 6 11\n1 1 2 3\n2 3 4\n1 4 5 6\n1 1 6\n1 2\n" + "".join(f"{w}\n" for w in range(1, 7))))
    text.save(lines(g), str(tmp_path / "out"))
    again = read(spark, str(tmp_path / "out"))
    assert _sets(again) == T6 and _weights(again) == _weights(g)


def test_matrix_market(spark, tmp_path):
    g = text.read_matrix_market(spark, _file(tmp_path, "%%MatrixMarket matrix coordinate real general\n% c\n3 2 3\n1 1 0.5\n3 1 1e3\n2 2 -1\n"))
    assert _sets(g) == {0: ([0, 2], 1), 1: ([1], 1)} and _weights(g) == [1, 1, 1]


# a 3 x 3 matrix with columns {1, 2}, {3}, {1, 3}: the second diagonal entry is missing
HB = "A title                                                                 KEY     \n{counts}\nPUA                        3             3             5             0\n(6I5)           (6I5)\n{rhs}    1    3    4    6\n    1    2    3    1    3\n"


@pytest.mark.parametrize("rhs", ["", "F 1 0\n"])
def test_harwell_boeing(spark, tmp_path, rhs):
    path = _file(tmp_path, HB.format(counts=f" 2 1 1 0 {1 if rhs else 0}", rhs=rhs))
    g = text.read_harwell_boeing(spark, path)
    assert _sets(g) == {0: ([0, 1], 1), 1: ([2], 1), 2: ([0, 2], 1)}
    filled = text.read_harwell_boeing(spark, path, fill_diagonal=True)
    assert _sets(filled) == {0: ([0, 1], 1), 1: ([1, 2], 1), 2: ([0, 2], 1)} and _weights(filled) == [2, 1, 2]
    two = text.read_harwell_boeing_2d(spark, path)
    assert two.verts.count() == 6 and text.zero_weight_vertices(two).count() == 1
    sizes = {r.e: r["count"] for r in two.pins.groupBy("e").count().collect()}
    assert sizes == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2}
    entries, header = text.harwell_boeing_entries(spark, path)
    assert [r.value for r in text.matrix_lines(entries, 3, 3).orderBy("n").collect()] == ["3 3 5", "0 1", "2", "0 2"]


def test_binary_round_trips(spark, tmp_path):
    pins = spark.createDataFrame([(e, v) for e, (p, _) in T6.items() for v in p], "e long, v long")
    hedges = spark.createDataFrame([(e, w) for e, (_, w) in T6.items()], "e long, w long")
    g = hypergraph(pins, spark.createDataFrame([(v, v + 1) for v in range(7)], "v long, w long"), hedges)
    binary.write_graph(g, f"file://{tmp_path}/g.bin")
    again = binary.read_graph(spark, str(tmp_path / "g.bin"))
    assert _sets(again) == _sets(drop_singletons(g)) and _weights(again) == list(range(1, 8))
    binary.write_shards(g, str(tmp_path / "g"), 2)
    shards = binary.read_shards(spark, str(tmp_path / "g"))
    assert sorted(_sets(shards).values()) == sorted(_sets(drop_singletons(g)).values()) and _weights(shards) == list(range(1, 8))


def test_partition_files(spark, tmp_path):
    parts = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "v long, part long")
    path = str(tmp_path / "parts")
    assert [tuple(r) for r in binary.write_vector(parts, path).collect()] == [(path, 12)]
    assert [r.part for r in binary.read_partition(spark, path).orderBy("v").collect()] == [1, 0, 1]
    pins = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 2)], "e long, v long")
    assert binary.score_partition(hypergraph(pins), spark, path) == 1
    assert np.frombuffer((tmp_path / "parts").read_bytes(), "<i4").tolist() == [1, 0, 1]


def test_dimacs(spark):
    pins = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2)], "e long, v long")
    found = [r.value for r in text.dimacs_lines(hypergraph(pins)).orderBy("n", "value").collect()]
    assert found == ["p edge 3 3", "e 1 2", "e 1 3", "e 2 3"]


def test_run_by_options(spark, tmp_path):
    pins = spark.createDataFrame([(e, v) for e in range(60) for v in (e % 40, (e * 7 + 1) % 40, (e // 2) % 40)], "e long, v long")
    g = hypergraph(pins, spark.range(40).selectExpr("id AS v", "1 AS w"))
    binary.write_shards(g, str(tmp_path / "g"), 3)
    ini = "hypergraph = {0}/g\nnumber-of-parts = 2\nwrite-partitions-to-file = true\ndisplay-info = true\ndisplay-progress = {1}\noutput-to-file = true\noutput-file = {0}/log-{1}\n[refinement]\nv-cycles = off\n"
    for progress in ("true", "false"):
        found = run(spark, Options(from_ini(ini.format(tmp_path, progress))))
        assert binary.score_partition(g, spark, str(tmp_path / "g.part.2")) == found.cut
        lines = (tmp_path / f"log-{progress}").read_text().splitlines()
        assert sum("plans.run: graph" in x for x in lines) == sum("plans.run: cuts" in x for x in lines) == 1
        assert any("plans.control: run 0" in x for x in lines) == (progress == "true")
    with pytest.raises(ValueError):
        run(spark, Options())


def test_graph_of_many_chunks_and_stretches(spark, tmp_path, monkeypatch):
    """Tasks read chunks side by side, and no row holds a file."""
    monkeypatch.setattr(binary, "BLOCK", 8)
    monkeypatch.setattr(binary, "RANGE", 16)
    monkeypatch.setattr(binary, "CHUNKS", 2)
    g = hypergraph(spark.range(60).selectExpr("id AS e", "explode(array(id, (id * 7 + 1) % 61, 60)) AS v"))
    binary.write_graph(g, str(tmp_path / "g.bin"))
    again = binary.read_graph(spark, str(tmp_path / "g.bin"))
    for a, b in zip((g.verts, g.hedges, g.pins), (again.verts, again.hedges, again.pins), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert list(binary._ranges(str(tmp_path / "g.bin")))[-1][0] == "v" and len(list(binary._ranges(str(tmp_path / "g.bin")))) == 8 + 4
    assert spark.read.format("binaryFile").load(str(tmp_path / "g.bin")).first().length == 4 * (3 + 8 + 61 + g.hedges.count() * 2 + g.pins.count())
