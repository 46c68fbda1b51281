import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pinweave.llm import op9_token_files, op10_packing
from pinweave.llm.tokens import encoder, vocabulary_path
from pinweave.storage import new_path

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = ["", " ", "\n", "\n\n a", "a  b", "a \n b", "\ta", "a\x1cb c", "a\xa0 b", "I'm  ok's", "<|endoftext|> a<|endoftext|>b", "é é ́x", "x\r\ny z", "  lead", "trail  ", None, "a .b ., c", "\r", "a\rb", "x. y, Z.", "Σας ΣΑΣ İx", "don't. can't,", "a \rb", "a...b foo!!!??? x&&& y.,", "5%. %5 é., e\u0301, \"q'.\" ***", "a\x85b c", "　x y"]


def _ids(code, texts):
    out = []
    for _, counts, ids in code.blocks(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("file, blanks", KINDS)
def test_odd_texts(file, blanks):
    code = encoder(vocabulary_path(file), blanks)
    assert _ids(code, ODD) == [code.library.encode(x or "", add_special_tokens=False).ids for x in ODD]


@pytest.mark.parametrize("file, blanks", KINDS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("aZé.,!*%&'< \n\t\r\xa0́ß9_-|Σ"), max_size=25), min_size=1, max_size=4))
def test_as_the_library(file, blanks, texts):
    code = encoder(vocabulary_path(file), blanks)
    assert _ids(code, texts) == [code.library.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_token_files(request, spark, table):
    docs = request.getfixturevalue(table)
    path = new_path(spark, "test")
    op9_token_files.write(docs, path)
    rows = sorted(op9_token_files.read(spark, path).collect(), key=lambda r: r.start)
    library = encoder(vocabulary_path("word_bpe_49k.json"), False).library
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())
    expected = sorted((i, *library.encode(x, add_special_tokens=False).ids, 1) for i, x in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r.ids) for r in rows) == expected
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_packing(request, table):
    docs = request.getfixturevalue(table)
    rows = op10_packing.pack(docs, size=64).collect()
    library = encoder(vocabulary_path("byte_bpe_50k.json"), True).library
    expected = sorted([*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect())
    places = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 256
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(own[-1]) <= 64
    assert sorted(places) == list(range(len(places)))
    cut = {}
    for r in sorted(rows, key=lambda r: (r.start)):
        cut.setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4").tolist())
    assert sum(len(x) for own in cut.values() for x in own) == sum(map(len, expected))
    assert sorted(cut.get(0, [])) == sorted(x[:64] for x in expected)


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(5, 1, 50_000).astype(int), 1, 1024)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    plan = op10_packing.patterns(histogram, 1024)
    held = {}
    for pack, n in plan:
        assert sum(pack) <= 1024
        for x in pack:
            held[x] = held.get(x, 0) + n
    assert held == histogram
    assert lengths.sum() / (1024 * sum(n for _, n in plan)) > 0.99


@pytest.mark.parametrize("rest, hot, n", [("uniform", 40, 50_000), ("lognormal", 100, 50_000), (None, 100, 100_000), (None, 520, 100_000)])
def test_little_padding_with_a_hot_length(rest, hot, n):
    rng = np.random.default_rng(1)
    others = {"uniform": rng.integers(1, 1025, 100_000), "lognormal": np.clip(rng.lognormal(5, 1, 100_000).astype(int), 1, 1024), None: np.zeros(0, int)}[rest]
    lengths = np.append(others, np.full(n, hot))
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    place = op10_packing.slots(op10_packing.patterns(histogram, 1024), 1024)
    begins = []
    for length, count in histogram.items():
        first, at, step = place[length]
        k = np.searchsorted(first, np.arange(count), side="right") - 1
        begins.append(np.stack((at[k] + (np.arange(count) - first[k]) * step[k], np.full(count, length)), 1))
    begin, length = np.concatenate(begins)[np.argsort(np.concatenate(begins)[:, 0])].T
    assert (begin[1:] >= (begin + length)[:-1]).all()
    assert lengths.sum() / (1024 * -(-(begin + length).max() // 1024)) > 0.98


def test_packing_cuts_a_hot_length(spark):
    docs = spark.createDataFrame([(i, " ".join(["a"] * 39)) for i in range(64)], "doc_id long, text string")
    rows = sorted(op10_packing.pack(docs, size=64).collect(), key=lambda r: (r.doc_id, r.start))
    whole, places = {}, {}
    for r in rows:
        assert r.start == len(whole.get(r.doc_id, b"")) // 4 and len(r.ids) == 4 * r.length
        whole[r.doc_id] = whole.get(r.doc_id, b"") + r.ids
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(whole) == 64 and len(set(whole.values())) == 1 and {len(x) for x in whole.values()} == {4 * rows[0].doc_tokens}
    assert sorted(places) == list(range(-(-64 * rows[0].doc_tokens // 64)))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(own[-1]) <= 64


def test_query_checksums(spark):
    from tests.conftest import SF

    library = encoder(vocabulary_path("byte_bpe_50k.json"), True).library
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op10_packing.op10_packing(spark, SF).collect():
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])


def test_token_files_can_be_read_in_parts(spark, documents, tmp_path):
    """Encodings, row groups and page indexes of the files, and what a selective read leaves out."""
    import pyarrow.parquet as pq

    path = tmp_path / "tokens"
    op9_token_files.write(documents.repartition(3), f"file://{path}", row_group_bytes=64 << 10, page_bytes=4 << 10)
    last = None
    for file in sorted(path.glob("part-*.parquet")):
        meta = pq.ParquetFile(file).metadata
        assert meta.num_row_groups > 1
        for k in range(meta.num_row_groups):
            group = meta.row_group(k)
            columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
            assert {"DELTA_BINARY_PACKED"} <= set(columns["doc_id"].encodings) & set(columns["local_start"].encodings)
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            stats = columns["doc_id"].statistics
            assert last is None or stats.min > last
            last = stats.max
            # metadata can be read without the tokens
            assert columns["doc_id"].total_compressed_size + columns["n_tokens"].total_compressed_size < columns["ids.list.element"].total_compressed_size / 10
    found = op9_token_files.read(spark, f"file://{path}").where(f"doc_id = {last}").select("doc_id", "n_tokens")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert found.count() == 1


@pytest.mark.parametrize("keeps_blanks, file", [(False, "word_bpe_49k.json"), (True, "byte_bpe_50k.json")])
def test_memo_stays_bounded_within_a_block(monkeypatch, keeps_blanks, file):
    """A block of 40,000 distinct words does not stay in the memo whole, and its ids are the library's."""
    from pinweave.llm import tokens as T

    monkeypatch.setattr(T, "GENERATION", 1000)
    monkeypatch.setattr(T, "STRETCH", 1000)
    code = T.Encoder(T.vocabulary_path(file), keeps_blanks)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join("".join(letters[i // 26**k % 26] for k in range(4)) + ("", ".", "!?")[i % 3] for i in range(40_000))
    ((_, counts, ids),) = code.blocks(pa.array([text, "", None, "Abc,\ndef. x"]))
    plain = [code.library.encode(x, add_special_tokens=False).ids for x in (text, "", "", "Abc,\ndef. x")]
    assert counts.tolist() == list(map(len, plain)) and ids.tolist() == sum(plain, [])
    assert len(code.young) + len(code.old) < 20_000


def test_long_words_are_encoded_once_a_block():
    """Before, the ids of a word too long for the memo were sought again for each run of marks behind it."""
    from pinweave.llm import tokens as T

    code, asked = T.Encoder(T.vocabulary_path("byte_bpe_50k.json"), True), []
    real, code.tokenize = code.tokenize, lambda x: asked.append(x) or real(x)
    text = "a " + " ".join("Wörterbuch" * 5 + mark for mark in ("", ",", ".", "?!", ","))
    ((_, counts, ids),) = code.blocks(pa.array([text]))
    assert ids.tolist() == code.library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    assert sum(len(x) > 50 for x in asked) == 1


def test_a_batch_is_encoded_in_small_blocks():
    """16 MB of text in one batch took some 150 MB beyond it when it was one block; two such tasks share an executor."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = np.array([a + b + c for a in "abcdefghijkl" for b in "aeiouy" for c in "klmnprst"])
    texts = [" ".join(words[own]) for own in rng.integers(0, len(words), (4200, 1000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    assert batch.nbytes > 16 << 20
    own, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        n = sum(len(x) for x in op10_packing.cut_texts(iter([batch]), 0, "byte_bpe_50k.json", 0, 1024))
        took = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(own)
    assert n >= len(texts) and took < 80 << 20, took
