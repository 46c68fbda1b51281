"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed character trigrams of its words, as written, and a
few binned shares of its form (distinct words, words said twice in a row,
repeated lines, capitals, marks, line length). Term weights are damped counts times inverse document
frequency; the leading right singular vectors of the labelled texts' matrix are
the latent space. The labelled vectors, ``SAMPLE_DOCS`` times ``DIMENSIONS``
numbers at most, go to every task. Each task computes the cosines of a block of
documents with all of them, takes the ``NEIGHBOURS`` nearest exactly, with all
that are as near as the last of these, and weighs their labels by similarity.
Vectors are rounded to whole numbers before they are multiplied, and the sums are exact
in double precision; so a score does not depend on the block that a document is in.

The bound is a parameter: labelled documents outside the held-out fold, lowest
by hash. Everything else covers all documents, whole.

Defined results: null and empty texts, and all texts when nothing is labelled,
score the share of label 1 among the labelled (0.5 without any); at ties for the
last place all vote; repeated documents score alike, row by row; repeated labels
of a document count by their mean, and of unlike texts of its id the smallest is
learned from; very long texts are scored whole; null labels and null doc_ids teach nothing; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm.tables import held_out, lean, table
from pinweave.llm.words import Block, blocks, letters, ngrams

SAMPLE_DOCS = 4000
DIMENSIONS = 64
NEIGHBOURS = 15
#: Trigram terms, and bins of each share of form.
TERMS = 3072
BINS = 8
SHARES = 7
#: Length of a bin's coordinate beside all terms' length of 1.
FORM = 0.6
WIDTH = TERMS + BINS * SHARES
#: Parts of 1 that entries of term vectors and axes, and of latent vectors, are rounded to. Sums of products of unit vectors stay below 2^53.
GRID, FINE = 1 << 20, 1 << 24
#: Texts and words that are counted at once.
ROWS, WORDS = 512, 200_000


class Model(NamedTuple):
    idf: np.ndarray  # (TERMS,)
    axes: np.ndarray  # (WIDTH, DIMENSIONS)
    vectors: np.ndarray  # (sample, DIMENSIONS), of length 1
    labels: np.ndarray  # (sample,)
    prior: float


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def counts(b: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, matrix of damped term counts) for runs of a block's texts."""
    codes, starts = letters(b.words)
    of = np.repeat(np.arange(len(b.words)), np.diff(np.append(starts, len(codes))))
    grams = ngrams(codes, 3, TERMS)
    inside = of[: len(grams)] == of[2:] if len(of) > 2 else np.zeros(0, bool)
    grams, of_gram = grams[inside], of[: len(grams)][inside]
    n_grams = np.bincount(of_gram, minlength=len(b.words))
    first = np.cumsum(n_grams) - n_grams
    upper = np.bincount(of, (codes >= 65) & (codes <= 90), len(b.words))
    marks = np.bincount(of, ((codes > 32) & (codes < 48) & (codes != 44) & (codes != 46)) | ((codes > 90) & (codes < 97)) | (codes > 122) & (codes < 127), len(b.words))
    size = np.bincount(of, minlength=len(b.words)) - 2.0
    lines = pc.split_pattern(b.texts, "\n")
    ends = lines.offsets.to_numpy()
    for at in range(0, len(b.texts), ROWS):
        to = min(at + ROWS, len(b.texts))
        flat = np.zeros((to - at) * TERMS, np.float32)
        begin, end = b.begins[at], b.begins[to]
        of_text = np.repeat(np.arange(to - at), np.diff(b.begins[at : to + 1]))
        for x in range(begin, end, WORDS):
            w = b.which[x : min(x + WORDS, end)]
            n = n_grams[w]
            ends_ = np.cumsum(n)
            g = grams[np.repeat(first[w] - (ends_ - n), n) + np.arange(ends_[-1])]
            rows = np.repeat(of_text[x - begin : x - begin + len(w)], n)
            low = int(rows[0]) if len(rows) else 0
            seen = np.bincount((rows - low) * TERMS + g)
            flat[low * TERMS : low * TERMS + len(seen)] += seen
        own = np.log1p(flat.reshape(-1, TERMS))
        w = b.which[begin:end]
        n_words = np.bincount(of_text, minlength=to - at)
        distinct = np.diff(np.searchsorted(np.unique(of_text * np.int64(len(b.words) + 1) + w), np.arange(to - at + 1) * np.int64(len(b.words) + 1)))
        n_lines = np.diff(ends[at : to + 1])
        coded = lines.values.slice(ends[at], ends[to] - ends[at]).dictionary_encode()
        line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of_line = np.repeat(np.arange(to - at), n_lines)
        apart = np.diff(np.searchsorted(np.unique(of_line * (len(coded.dictionary) + 1) + line), np.arange(to - at + 1) * (len(coded.dictionary) + 1)))
        total = np.bincount(of_text, size[w], to - at)
        again = np.zeros(end - begin, bool)
        again[1:] = (w[1:] == w[:-1]) & (of_text[1:] == of_text[:-1])
        forms = [
            _share(distinct, n_words),
            _share(np.bincount(of_text, again, to - at), n_words),
            1 - _share(apart, n_lines),
            _share(np.bincount(of_text, upper[w], to - at), total),
            4 * _share(np.bincount(of_text, marks[w], to - at), total),
            _share(n_words, n_lines) / 40,
            np.log1p(n_words) / 10,
        ]
        bins = np.zeros((to - at, SHARES * BINS), np.float32)
        for k, form in enumerate(forms):
            bins[np.arange(to - at), k * BINS + np.minimum(np.sqrt(np.clip(form, 0, 1)) * BINS, BINS - 1).astype(int)] = n_words > 0
        yield at, np.concatenate((own, bins), 1)


def _weighed(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.concatenate((_unit(x[:, :TERMS] * idf), FORM * x[:, TERMS:]), 1)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def project(terms: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Latent vectors of length 1, each entry a whole number of parts of ``FINE``. Rows don't depend on each other."""
    own = np.rint(_weighed(terms, idf).astype(np.float64) * GRID) @ np.rint(axes.astype(np.float64) * GRID)
    return np.rint(_unit(own) * FINE) / FINE


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The latent space and labelled vectors of a bounded sample."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    lowest = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = lean(docs).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(lowest), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                for at, x in counts(b):
                    rows = slice(b.at + at, b.at + at + len(x))
                    own = [batch.column(c).slice(rows.start, len(x)) for c in ("doc_id", "quality")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "quality", "terms"])

    got = sample.mapInArrow(vectors, "doc_id long, quality double, terms binary").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return Model(np.ones(TERMS, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.frombuffer(b"".join(got["terms"]), np.float16).reshape(-1, WIDTH).astype(np.float32)
    y = got["quality"].to_numpy()
    del got
    idf = (np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(0))) + 0.1).astype(np.float32)
    raw, x = x, _weighed(x, idf)
    # leading right singular vectors by subspace iteration
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((len(x), DIMENSIONS + 16), np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    axes = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :DIMENSIONS].astype(np.float32)
    vectors = np.concatenate([project(raw[at : at + ROWS], idf, axes) for at in range(0, len(raw), ROWS)])
    return Model(idf, axes, vectors, y, float(y.mean()))


def score(model: Model, terms: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The weighted vote of the nearest labelled vectors, for each row of ``terms``."""
    if not len(model.vectors):
        return np.full(len(terms), model.prior)
    similar = (project(terms, model.idf, model.axes) * FINE) @ np.rint(model.vectors.T * FINE) / FINE**2
    k = min(neighbours, similar.shape[1])
    last = np.partition(similar, similar.shape[1] - k, axis=1)[:, -k, None]
    row, near = np.nonzero(similar >= last)
    weight = np.maximum(similar[row, near], 0).astype(np.float64) ** 4
    total = np.bincount(row, weight, len(terms))
    vote = np.bincount(row, weight * model.labels[near], len(terms)) / np.maximum(total, 1e-300)
    return np.clip(np.where((total > 0) & (terms.sum(1) > 0), vote, model.prior), 0, 1)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                for at, terms in counts(b):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.at + at, len(terms)), pa.array(score(shared.value, terms))], ["doc_id", "score"])

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
