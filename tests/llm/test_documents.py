import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinweave.llm import op1_quality_classifier as op1
from pinweave.llm import op2_secret_scans as op2
from pinweave.llm import op3_language_id as op3
from pinweave.llm import op4_jaccard_join as op4
from pinweave.llm import op5_source_mixing as op5
from pinweave.llm import op7_quality_rules as op7
from tests.conftest import SF


def test_sql(compare):
    for name in ("op5_source_mixing", "op7_quality_rules", "op8_chat_formatting"):
        compare(name)


# -- quality classifier


def test_scores_do_not_depend_on_blocks():
    """Copies score alike bit by bit, in blocks of all sizes, and labelled copies are equally near."""
    rng = np.random.default_rng(12)
    terms = np.log1p(rng.poisson(0.2, (60, op1.WIDTH))).astype(np.float32)
    terms[20:40] = terms[3]
    axes = np.linalg.qr(rng.standard_normal((op1.WIDTH, 24)))[0].astype(np.float32)
    idf = rng.random(op1.TERMS).astype(np.float32) + 0.1
    vectors = op1.project(np.concatenate((terms[:30], terms[:30])), idf, axes)
    model = op1.Model(idf, axes, vectors, rng.integers(0, 2, 60).astype(float), 0.5)
    whole = op1.score(model, terms)
    assert len(set(whole[20:40]) | {whole[3]}) == 1
    for size in (1, 2, 3, 7, 16, 33):
        parts = np.concatenate([op1.score(model, terms[i : i + size]) for i in range(0, 60, size)])
        assert (parts == whole).all()
    assert (op1.project(terms[5:6], idf, axes) == vectors[5]).all() and (vectors[:30] == vectors[30:]).all()



def test_classifier_tells_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = op1.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in found) / len(found) > 0.9
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_vote_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(9)
    vectors = op1._unit(rng.standard_normal((40, 8))).astype(np.float32)
    vectors[20:] = vectors[:20]  # ties everywhere
    labels = rng.integers(0, 2, 40).astype(float)
    model = op1.Model(np.ones(op1.TERMS, np.float32), rng.standard_normal((op1.WIDTH, 8)).astype(np.float32), vectors, labels, 0.5)
    terms = rng.poisson(0.3, (12, op1.WIDTH)).astype(np.float32)
    own = op1._unit(op1._weighed(terms, model.idf) @ model.axes)
    for x, got in zip(own, op1.score(model, terms, 5), strict=True):
        similar = sorted(((float(x @ v), y) for v, y in zip(vectors, labels, strict=True)), reverse=True)
        near = [(c, y) for c, y in similar if c >= similar[4][0] - 1e-6]
        weights = [max(c, 0) ** 4 for c, _ in near]
        assert abs(got - sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights)) < 1e-4


def test_classifier_odd(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)] + [(100, 1), (None, 1), (101, None)], "doc_id long, quality int")
    model = op1.learn(odd, labels)
    rows = op1.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = [r.score for r in rows if r.doc_id in (4, 5, 6)]
    assert empty == [model.prior] * 3
    assert op1.classify(none, model).count() == 0
    blank = op1.learn(none, labels.limit(0))
    assert {r.score for r in op1.classify(odd, blank).collect()} == {0.5}


# -- secrets


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


HARD = ["token:token:abcdefghij", "token=ab secret=abcdefgh", "API_KEY : 'abcdefgh' apikey=\"x.y-z_+/=\"", "é token = abcdefgh é AKIA1234567890AB", "AKIAAKIA1234", "a" * 40 + " AKIAAKIA12345678", "f" * 31 + "g" + "0" * 32, "PassWord=12345678,passwd=1234567", "", None, "key dGhpcyBpcyBhIHNlY3JldCBrZXkx in" + " x" * 30]


def test_base_spans(spark, documents):
    hard = spark.createDataFrame([(-i - 1, x) for i, x in enumerate(HARD)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(hard)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in op2.scan(docs).collect():
        assert [tuple(x) for x in r.base] == _base(texts[r.doc_id]), r.doc_id
        assert {tuple(x) for x in r.base} <= {tuple(x) for x in r.spans}


def test_query_digest(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op2.op2_secret_scans(spark, SF).collect():
        said = ",".join(f"{op2.KINDS[k]}:{a}:{b}" for a, k, b in _base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_markov_spans_against_brute_force(spark, documents):
    samples = op2.default_samples(documents).cache()
    model = op2.train(samples)
    threshold, recall = op2.threshold_of(samples, model)
    assert recall > 0.97
    planted = ["dGhpcyBpcyBhIHNlY3JldCBrZXk", "AKx9fQ2LmZp8Wv3Rt7Yc1Nb5", "9F8E7D6C5B4A39281706F5E4D3C2B1A09F8E7D6C", "qzkxwvjhtrpbmcdgyfns", "x7k2q9w4z8v3j6h1t5r0", "thtionherreandstoningthe", "erthon_what_han_tin_theare", "short1"]
    rows = [(i, f"see {x} here, é {x}") for i, x in enumerate(planted)] + [(20, "token=AKx9fQ2LmZp8Wv3Rt7Yc1Nb5"), (21, " ".join(planted) + " 0123456789abcdef0123456789abcdef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents.select((F.col("doc_id") + 100).alias("doc_id"), "text"))

    def score(token):
        at = [op2.ALPHABET.index(c) for c in token]
        return sum(model[a * len(op2.ALPHABET) + b] for a, b in zip(at, at[1:], strict=False)) / (len(token) - 1)

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    scanned = op2.scan(docs, samples)
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in scanned.collect()}
    clean = {r.doc_id: r.text for r in op2.redacted(scanned).collect()}
    for i, text in texts.items():
        base = _base(text)
        more = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if score(m[0]) > threshold]
        want = sorted(base + [s for s in more if not any(b[0] < s[2] and s[0] < b[2] for b in base)])
        assert found[i] == want, i
        out, at = "", 0
        for a, _, b in want:
            out += "" if a < at else text[at:a] + "[SECRET]"
            at = max(at, b)
        assert clean[i] == out + text[at:] or not text
    assert all(len(found[i]) == 2 for i in range(5)) and not found[5] and not found[7]


def test_many_matches(spark):
    text = " ".join(f"tökén token=abcdefgh{i}" for i in range(700))
    row = op2.redacted(op2.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), threshold=0.0)).first()
    assert row.text == " ".join("tökén [SECRET]" for _ in range(700))


def test_secrets_odd(odd, none):
    rows = op2.scan(odd).collect()
    assert len(rows) == odd.count()
    assert sum(len(r.spans) for r in rows if not r.text) == 0
    assert op2.scan(none).count() == 0
    kept = {r.doc_id: r.text for r in op2.redacted(op2.scan(odd)).collect()}
    assert kept[4] is None and kept[9] == '[SECRET]" and [SECRET]'


# -- languages


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op3.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97


def test_languages_odd(odd, none, documents):
    model = op3.learn(documents)
    rows = op3.identify(odd, model, with_spans=True).collect()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count()
    for i in (4, 5, 6, 7):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[1].lang_pred == "en" and len({r.lang_pred for r in rows if r.doc_id is None} - {"und"}) == 1
    assert {r.doc_id for r in op3.in_a_language(odd, model).collect()}.isdisjoint({4, 5, 6, 7})
    assert op3.identify(none, model).count() == 0 and op3.in_a_language(none, model).count() == 0
    blank = op3.learn(none)
    assert {r.lang_pred for r in op3.identify(odd, blank).collect()} == {"und"}


def test_spans_of_mixed_text(spark, documents):
    model = op3.learn(documents)
    pure = {lang: " ".join(r.text.split()[:60]) for lang in ("en", "de") for r in [documents.where(F.col("lang") == lang).where("length(text) > 600").orderBy("doc_id").first()]}
    mixed = spark.createDataFrame([(1, pure["en"] + " " + pure["de"])], "doc_id long, text string")
    spans = op3.identify(mixed, model, with_spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[0].end - 60) <= 3


def test_viterbi_against_every_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    evidence = -rng.integers(0, 12, (9, 3)).astype(np.float32)
    texts = [rng.integers(0, 9, n) for n in (0, 1, 2, 6, 7, 3)]
    begins = np.cumsum([0] + [len(x) for x in texts])
    labels = op3.viterbi(begins, np.concatenate(texts).astype(int), evidence, 5.0)
    for a, b, words in zip(begins, begins[1:], texts, strict=False):

        def worth(path, words=words):
            return sum(evidence[w, k] for w, k in zip(words, path, strict=True)) - 5.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))

        assert not len(words) or worth(tuple(labels[a:b])) == max(map(worth, itertools.product(range(3), repeat=len(words))))


# -- Jaccard join


def _brute(docs, n, num, den):
    sets = {}
    for r in docs:
        words = (r.text or "").encode().lower().split()
        k = min(n, len(words))
        sets[r.doc_id] = frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_classes(documents, n, num, den):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op4.classes_of(documents, n, num, den).collect()}
    assert found == _brute(documents.collect(), n, num, den)


def test_classes_of_short_texts_and_chains(spark):
    """Tiny sets share the cells of sparse sets, where trees prune; chains of edits link far ends."""
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join([f"x{j}" if j < 2 * i else w for j, w in enumerate(words)]) for i in range(12)]
    tiny = [" ".join(words[i : i + 2 + i % 9]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(chain + tiny)), "doc_id long, text string")
    for n, num, den in [(1, 9, 10), (1, 4, 5), (3, 4, 5)]:
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in op4.classes_of(docs, n, num, den).collect()}
        assert found == _brute(docs.collect(), n, num, den)


def test_trees_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.poisson(1.0, (150, op4.GROUPS)).astype(np.int32)
    points[50:100] = points[:50]
    points[50:100, 0] += 2
    sizes, t = points.sum(1), op4.Threshold(4, 5)
    classes = np.arange(150)
    near = {(i, j) for i in range(150) for j in range(i) if np.minimum(points[i], points[j]).sum() >= t.needed(sizes[i], sizes[j])}

    def found(tile, classes=classes):
        return {(max(p), min(p)) for xs, ys in op4.join(points, sizes, classes, tile, t) for p in zip(xs.tolist(), ys.tolist(), strict=True)}

    one = found(np.zeros(150, int))
    assert one >= {p for p in near if 4 * max(sizes[list(p)]) <= 5 * min(sizes[list(p)])} and one <= near
    tile = (np.arange(150) % 2).astype(int)
    assert found(tile) == {p for p in one if tile[p[0]] != tile[p[1]]}
    assert not found(np.zeros(150, int), np.zeros(150, int))
    tree = op4.Tree(points, sizes, classes)
    assert [len(x[0]) for x in tree.levels] == [10, 1] and sorted(tree.order) == list(range(150))


def test_texts_of_one_id_and_rows_without_one(spark):
    """Links of unlike texts of an id, and over rows that have none, are not lost."""
    words = [f"w{i}" for i in range(80)]
    a, b = " ".join(words), " ".join(words[::-1])
    chain = [" ".join([f"x{j}" if j < 3 * i else w for j, w in enumerate(words)]) for i in range(3)]
    for rows in ([(1, a), (1, b), (2, a + " more"), (3, b + " more")], [(3, b + " more"), (2, a + " more"), (1, b), (1, a), (1, a)]):
        found = {(r.doc_id, r.component_id) for r in op4.classes_of(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
        assert found == {(1, 1), (2, 1), (3, 1)}
    rows = [(10, chain[0]), (None, chain[1]), (11, chain[2]), (None, "alone with five words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.component_id) for r in op4.classes_of(docs, 1, 9, 10).collect()]
    assert sorted(found, key=str) == sorted([(10, 10), (None, 10), (11, 10), (None, None), (None, None)], key=str)
    left = [(r.doc_id, r.text) for r in op4.first_of_each(docs, 1, 9, 10).collect()]
    assert sorted(left, key=str) == sorted([rows[0], rows[3], rows[4]], key=str)


def test_cells_of_a_hot_key_stay_apart(spark):
    """Texts that share most of a passage, and more nodes than a tile holds: links as by brute force, a forest at most."""
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"own{i}x{j}" for j in range(3 + i % 9)])) for i in range(150)]
    docs = spark.createDataFrame(rows + [(200 + i, t.replace("p7", f"q{i}")) for i, t in rows[::10]], "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op4.classes_of(docs, 1, 9, 10).collect()}
    assert found == _brute(docs.collect(), 1, 9, 10)

def test_classes_odd(odd, none):
    rows = op4.classes_of(odd, 3, 9, 10).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (4, 5, 6))
    assert op4.classes_of(none).count() == 0


# -- mixing and rules


def test_mixing_odd(odd, none):
    rows = op5.mix(odd).collect()
    assert {"copy", "n_copies", "shuffle_key"} <= set(rows[0].asDict())
    copies = Counter((r.doc_id, r.text, r.copy) for r in rows)
    twice = [n for (i, _, _), n in copies.items() if i == 2]
    assert set(twice) <= {2}
    assert op5.mix(none).count() == 0
    assert {r.source for r in op5.mix(odd, weights={"a": 1.0}).collect()} <= {"a"}


def test_mixing_meets_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"))
    n = {r.source: r["count"] for r in op5.mix(docs, weights={"big": 0.5, "small": 0.5}).groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 400 and abs(n["small"] - 10_000) < 700
    assert [r.shuffle_key for r in op5.mix(docs).limit(5).collect()] == [r.shuffle_key for r in op5.mix(docs).limit(5).collect()]


def test_mixing_of_small_sources_and_rows_without_ids(spark):
    docs = spark.range(40_000).select(F.when(F.col("id") < 30_000, F.col("id")).alias("doc_id"), F.concat(F.lit("x"), F.col("id")).alias("text"), F.when(F.col("id") < 8, "rare").otherwise("big").alias("source"))
    mixed = op5.mix(docs, weights={"big": 0.5, "rare": 0.5}).cache()
    n = [r.n for r in mixed.where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert len(set(n)) > 3 and all(6700 < x < 7600 for x in n)
    none = mixed.where("doc_id IS NULL")
    assert none.select("shuffle_key").distinct().count() > 0.9 * none.count() > 3000
    assert mixed.agg(F.max("copy"), F.max("n_copies")).first()[0] == max(n)


def test_rules_judge_rows(spark):
    line = "subscribe to our newsletter now and never miss a story again my friends"
    own = " ".join(f"plain{i}" for i in range(8))
    rows = [(i, f"{line}\nown{i} {' '.join(f'w{i}x{j}' for j in range(30))}") for i in range(20)] + [(100, f"{line}\n{own}"), (100, f"{own} and some words that stand alone"), (None, f"{line}\n{own} z"), (None, f"{own} other words without the line")]
    found = op7.judge(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))).collect()
    assert len(found) == len(rows)
    assert sorted((r.removed_words, r.kept) for r in found if r.doc_id in (100, None)) == [(0, True), (0, True), (13, False), (13, False)]
    assert all(r.removed_words == 13 and r.kept for r in found if r.doc_id is not None and r.doc_id < 20)


def test_rules_odd(spark, odd, none):
    rows = op7.judge(odd).collect()
    assert len(rows) == odd.count() and op7.judge(none).count() == 0
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[4].n_words == 0 and by_id[4].base_failed and not by_id[4].kept
    assert by_id[8].n_repeat_words == 40_000 and by_id[8].base_failed
    assert by_id[100].kept
    line = "subscribe to our newsletter now and never miss a story again friends"
    docs = spark.createDataFrame([(i, f"{line}\nown{i}" + (" word%d" * 30 % tuple(range(i, i + 30)) if i % 2 else "")) for i in range(40)], "doc_id long, text string").withColumn("source", F.lit("h"))
    assert {r.doc_id % 2 for r in op7.judge(docs).where("kept").collect()} == {1}
    copies = docs.withColumn("text", F.lit(f"{line}\n{line[::-1]}"))
    assert op7.judge(copies).where("kept").count() == 0 and op7.judge(copies.limit(10)).where("kept").count() == 10


def test_every_language_is_learned_at_every_size(spark):
    rows = [(i, "en", f"plain words of text number {i}") for i in range(1000)] + [(1000 + i, "ru", f"простые слова текста номер {i}") for i in range(1001)] + [(5000 + i, "ka", "ქართული ენა არის") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = op3.learn(docs, sample_docs=20)
    assert sorted(model.languages) == ["en", "ka", "ru"]
    found = {r.lang_pred for r in op3.identify(docs.where("lang = 'ka'"), model).collect()}
    assert found == {"ka"} and op3.in_a_language(docs, model).where("lang = 'ka'").count() == 12
