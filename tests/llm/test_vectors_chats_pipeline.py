import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pinweave.llm import components, op6_embedding_dedup, op8_chat_formatting
from tests.conftest import SF


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base + rng.standard_normal((60, 32)) * s for s in (0, 0, 0.1, 0.2, 0.3, 0.4)])
    label = np.tile(np.arange(60) % 3, 6)
    found = {r.vec_id: r for r in op6_embedding_dedup.classes_of(_vectors(spark, [(i, v.astype(np.float32).tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))])).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links = np.array([found[i].n_links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()


def test_large_cells_are_tiled(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.ones(16) + rng.standard_normal((60, 16)) * 0.01
    vectors = _vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    whole = sorted(map(tuple, op6_embedding_dedup.classes_of(vectors).collect()))
    monkeypatch.setattr(op6_embedding_dedup, "TILE", 8)
    assert sorted(map(tuple, op6_embedding_dedup.classes_of(vectors).collect())) == whole
    assert {c for _, _, c, _ in whole} == {0}


def _recall(spark, x):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    rows = op6_embedding_dedup.classes_of(_vectors(spark, [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)])).collect()
    return sum(r.n_links for r in rows) / (near.sum() - len(x)), near.sum() - len(x)


def test_recall_on_one_tight_cluster(spark):
    recall, n = _recall(spark, np.ones(16) + np.random.default_rng(6).standard_normal((60, 16)) * 0.01)
    assert n == 60 * 59 and 0.95 <= recall <= 1


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_recall_near_the_threshold(spark, spread):
    """Pairs at a cosine of 0.935, of vectors about no mean and in a narrow cone."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 64)) + spread
    w = rng.standard_normal(x.shape)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    w -= (w * x).sum(1, keepdims=True) / size**2 * x
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * w / np.linalg.norm(w, axis=1, keepdims=True) * size
    recall, n = _recall(spark, np.concatenate([x, y]))
    assert n >= 1200 and recall >= 0.95


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], None), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None)]
    found = op6_embedding_dedup.classes_of(_vectors(spark, rows).withColumn("class", F.lit(1)).withColumn("n", F.lit(1))).collect()
    assert len(found) == len(rows)
    by_id = {r.vec_id: r for r in found if r.vec_id is not None}
    assert (by_id[0].n_links, by_id[1].n_links, by_id[1].component_id) == (3, 3, 0)
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in (2, 3, 4, 5, 6, 7, 8, 9, 10))
    assert op6_embedding_dedup.classes_of(_vectors(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    found = {r.v: r.c for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    assert found == {v: root(v) for v in parent}


def _chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_calls_and_results(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"})),
        (1, 2, "assistant", _call(("a", "search", {"query": "x", "limit": 3}))),
        (1, 3, "assistant", _call(("b", "search", {"limit": "many"}))),
        (1, 4, "assistant", _call(("c", "unknown_tool", '{"z":1,"a":2}'))),
        (1, 5, "tool", json.dumps({"tool_call_id": "c", "content": 1})),
        (1, 6, "tool", json.dumps({"tool_call_id": "c", "content": 2})),
        (1, 7, "tool", json.dumps({"tool_call_id": "zz", "content": 0})),
        (1, 8, "assistant", _call(("d", "calculate", {"expression": "1+1"}))),
        (2, 0, "tool", json.dumps({"tool_call_id": "d", "content": "other conversation"})),
        (2, 1, "assistant", '{"tool_calls": [broken'),
    ]
    found = op8_chat_formatting.format_chats(_chat(spark, rows)).orderBy("conv_id", "position").collect()
    assert [(r.turn, r.status) for r in found if r.conv_id == 1] == [(0, "text"), (2, "linked"), (1, "linked"), (3, "invalid"), (4, "linked"), (5, "linked"), (6, "repeated"), (7, "orphan"), (8, "open")]
    assert [(r.turn, r.status) for r in found if r.conv_id == 2] == [(0, "orphan"), (1, "text")]
    assert found[4].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"a":2,"z":1},"id":"c","name":"unknown_tool"}]}'


def test_chats_odd(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (1, None, "user", "x"), (1, 0, "user", "é\n\""), (1, 0, "user", "é\n\""), (1, 0, None, "long " * 50_000), (3, 0, "assistant", _call(("a", "search", {"query": "q"}))), (3, 0, "assistant", _call(("a", "search", {"query": "q"}))), (3, 1, "tool", '{"tool_call_id": "a"}')]
    found = op8_chat_formatting.format_chats(_chat(spark, rows).withColumn("position", F.lit(1))).collect()
    assert len(found) == len(rows)
    for conv in (None, 1, 3):
        own = sorted(r.position for r in found if r.conv_id == conv)
        assert own == list(range(len(own)))
    assert op8_chat_formatting.format_chats(_chat(spark, [])).count() == 0


def test_texts_with_a_common_beginning(spark):
    """Texts that differ behind their first characters are in order all the same, and so are results behind their calls."""
    long = "x" * 200
    rows = [(1, 0, "user", f"{long}{i % 7}{i}") for i in range(60)] + [(1, 0, "assistant", _call((str(i), "search", {"query": long + str(i)}))) for i in range(9)] + [(1, 0, "tool", json.dumps({"content": long, "tool_call_id": str(i)})) for i in range(9)]
    found = op8_chat_formatting.format_chats(_chat(spark, rows).repartition(5)).orderBy("position").collect()
    assert [r.position for r in found] == list(range(78))
    assert [r.message for r in found if r.kind == "text"] == [json.dumps({"content": t, "role": "user"}, separators=(",", ":"), sort_keys=True) for t in sorted(x[3] for x in rows[:60])]
    assert {r.status for r in found if r.role != "user"} == {"linked"}
    at = {}
    for r in found:
        for i in [c["id"] for c in json.loads(r.message).get("tool_calls", [])] if r.kind == "call" else [json.loads(r.message)["tool_call_id"]] if r.kind == "result" else []:
            at.setdefault(i, []).append((r.position, r.kind))
    assert all([kind for _, kind in sorted(x)] == ["call", "result"] for x in at.values())


def test_long_conversation(spark):
    rows = _chat(spark, [(1, i, "user", f"m{i}") for i in range(3000)] + [(2, i, "user", "x") for i in range(5)]).repartition(7)
    found = op8_chat_formatting.format_chats(rows).collect()
    assert all(r.position == r.turn for r in found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(spark, odd, none, name, stage):
    assert stage(spark, odd, SF).columns == odd.columns
    out = stage(spark, odd, SF)
    out.write.format("noop").mode("overwrite").save()
    assert stage(spark, none, SF).count() == 0


def test_stage_decisions(spark, odd):
    by_name = dict(corpus_pipeline.STAGES)
    near = [r.doc_id for r in by_name["near_duplicates"](spark, odd, SF).collect()]
    assert near.count(1) == 1 and 2 not in near and 3 not in near and near.count(None) == 2
    clean = {r.doc_id: r for r in by_name["secret_scans"](spark, odd, SF).collect()}
    assert "24be64" not in clean[9].text and clean[9].n_chars == len(clean[9].text) and clean[4].text is None
    assert by_name["packing"](spark, odd, SF).count() > 0 and by_name["packing"](spark, odd.limit(0), SF).count() == 0


def test_odd_json(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"\\ud800","name":"f","arguments":{"q":"\\ud800é"}}]}'),
        (1, 1, "tool", '{"tool_call_id":"\\ud800","content":"ok"}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"b","name":"f","arguments":NaN}]}'),
        (1, 3, "assistant", '{"tool_calls":[{"id":"c","name":"f","arguments":"{\\"x\\":1e999}"}]}'),
        (1, 4, "assistant", '{"tool_calls":' + "[" * 100_000),
    ]
    found = op8_chat_formatting.format_chats(_chat(spark, rows)).orderBy("position").collect()
    assert [r.status for r in found] == ["linked", "linked", "text", "invalid", "text"]
    assert all(json.loads(r.message) is not None and "NaN" not in r.message[:60] for r in found)
    assert found[0].message == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"q":"\\ud800é"},"id":"\\ud800","name":"f"}]}'


def test_pipeline_against_plain_steps(spark, documents):
    """What run() returns is what plain versions of the stages give, row by row."""
    import hashlib
    import math
    import zlib
    from collections import Counter

    from tokenizers import Tokenizer

    from pinweave.llm import op2_secret_scans, op3_language_id
    from pinweave.llm.tokens import vocabulary_path
    from tests.llm.test_documents import _brute

    model = op3_language_id.learn(documents)
    spoken = {r.doc_id for r in op3_language_id.identify(documents, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    rows = {r.doc_id: r for r in documents.collect() if r.doc_id in spoken}
    classes = _brute(rows.values(), 5, 4, 5)
    kept = {i: r for i, r in rows.items() if classes[i][1] == i}
    left = documents.where(F.col("doc_id").isin(list(kept)))
    texts = {}
    for r in op2_secret_scans.scan(left).collect():
        out, at = "", 0
        for a, _, b in r.spans:
            out += "" if a < at else r.text[at:a] + "[SECRET]"
            at = max(at, b)
        texts[r.doc_id] = out + r.text[at:]
    chars: Counter = Counter()
    for i, r in kept.items():
        chars[r.source] += len(texts[i])
    whole, roots = sum(chars.values()), sum(math.sqrt(x) for x in chars.values())
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want: Counter = Counter()
    for i, r in kept.items():
        rate = math.sqrt(chars[r.source]) / roots * whole / chars[r.source]
        draw = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, upto = 0, math.exp(-rate), math.exp(-rate)
        while upto < draw:
            n += 1
            p *= rate / n
            upto += p
        want[i] += n
    got: Counter = Counter()
    pieces: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.start == 0
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == +want
    for i, own in pieces.items():
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        assert sum(r.length for r in own) == want[i] * len(ids)
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 1024
