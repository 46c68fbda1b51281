"""Language identification of whole texts and of the spans of mixed ones.

The script of a word's letters narrows its candidate languages; hashed
character bigrams and trigrams score it under each; Viterbi over the words, with
a penalty for each switch, labels spans. Texts of a block step through their
words together, so the work is vectorised over texts, and memory is bounded by
the block, not by a text's length times a batch's rows.

The model is learned from ``SAMPLE_DOCS`` documents of each language at most
(lowest by hash, outside the held-out fold, with a text), so that every labelled
language is learned at every size: counts per (language, bucket), a table
bounded by languages times ``BUCKETS``. Everything else covers all documents,
whole.

Defined results: a null text or one without letters is ``und`` with score 0;
where nothing could be learned, every text is; a text whose letters are all in
scripts of no learned language gets the most frequent one with score 0;
repeated rows are judged one by one; null doc_ids, languages and sources and
further columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.tables import give_back, held_out, lean, table
from pinweave.llm.words import Block, blocks, letters, ngrams

SAMPLE_DOCS = 3000
BUCKETS = 1 << 14
#: A word's evidence against a language, and the price of a switch, in nats.
MOST_EVIDENCE = 12.0
SWITCH = 8.0
#: A language uses a script in which this share of its letters is.
SCRIPT_SHARE = 0.02

#: First code point of each range and the script of its letters.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"),
    (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_FIRST = np.array([x for x, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(x) for _, x in SCRIPT_RANGES])
_ALPHA = np.array([chr(x).isalpha() for x in range(0x110000)])


class Model(NamedTuple):
    languages: list[str]  # most frequent first
    evidence: np.ndarray  # (BUCKETS, languages): log probability of an n-gram
    allowed: np.ndarray  # (scripts, languages): whether the language uses the script


class _Words(NamedTuple):
    grams: np.ndarray
    of_word: np.ndarray  # word of each n-gram
    n_letters: np.ndarray
    script: np.ndarray  # script of most of a word's letters


def _looked_at(words: pa.Array) -> _Words:
    import pyarrow.compute as pc

    codes, begins = letters(pc.utf8_lower(words))
    if not len(begins):
        none = np.zeros(0, np.int64)
        return _Words(none, none, none, none)
    alpha = _ALPHA[codes]
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(codes))))
    n_letters = np.add.reduceat(alpha, begins, dtype=np.int64)
    per_script = np.bincount(of[alpha] * len(SCRIPTS) + _SCRIPT[np.searchsorted(_FIRST, codes[alpha], side="right") - 1], minlength=len(begins) * len(SCRIPTS))
    grams, of_word = [], []
    for n in (2, 3):
        own = ngrams(codes, n, BUCKETS)
        inside = of[: len(own)] == of[n - 1 :]
        some = np.add.accumulate(alpha.astype(np.int64))
        some = some[n - 1 :] - some[: len(own)] + alpha[: len(own)] > 0
        grams.append(own[inside & some])
        of_word.append(of[: len(own)][inside & some])
    return _Words(np.concatenate(grams), np.concatenate(of_word), n_letters, per_script.reshape(-1, len(SCRIPTS)).argmax(1))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Character statistics of each language, from documents outside the held-out fold."""
    open_rows = lean(docs).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    known = open_rows.where("doc_id IS NOT NULL").select("lang", "doc_id").distinct()
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    # about twice the documents wanted of each language, so that no task ranks all of one
    ends = [(x, min(2**63 - 1, -(2**63) + 2**65 * sample_docs // n)) for x, n in totals.items()]
    low = known.join(F.broadcast(docs.sparkSession.createDataFrame(ends, "lang string, end long")), "lang").where(F.xxhash64("doc_id") <= F.col("end"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    lowest = low.withColumn("rank", rank).where(F.col("rank") <= sample_docs).select("lang", "doc_id")
    sample = open_rows.join(F.broadcast(lowest), ["lang", "doc_id"], "left_semi").select("lang", F.col("text").cast("string"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            lang, langs = names.indices.to_numpy(), names.dictionary.to_pylist()
            for b in blocks(batch.column("text")):
                seen = _looked_at(b.words)
                lang_of_word = np.repeat(lang[b.at : b.at + len(b.texts)], np.diff(b.begins))
                times = np.bincount(lang_of_word.astype(np.int64) * len(b.words) + b.which, minlength=len(langs) * len(b.words)).reshape(len(langs), -1)
                for i, name in enumerate(langs):
                    grams = np.bincount(seen.grams, times[i][seen.of_word], BUCKETS).astype(np.int64)
                    scripts = np.bincount(seen.script, times[i] * seen.n_letters, len(SCRIPTS)).astype(np.int64)
                    both = np.concatenate((grams, scripts))
                    at = np.flatnonzero(both)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(both[at])], ["lang", "at", "n"])
        give_back()

    counts = sample.mapInArrow(counted, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(map(str, counts[counts["at"] < BUCKETS]["lang"].unique()), key=lambda x: (-totals[x], x))
    every = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        every[own["at"], i] = own["n"]
    grams, scripts = every[:BUCKETS] + 0.5, every[BUCKETS:]
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def _evidence(model: Model, seen: _Words) -> np.ndarray:
    """(words, languages): at most 0, and 0 for all where a word tells nothing."""
    n = len(seen.n_letters)
    score = np.stack([np.bincount(seen.of_word, model.evidence[seen.grams, i], n) for i in range(len(model.languages))], 1)
    allowed = model.allowed[seen.script]
    tells = (seen.n_letters > 0) & allowed.any(1)
    score[~allowed] = -np.inf
    best = np.where(tells, score.max(1, initial=-np.inf), 0.0)
    score = np.where(tells[:, None], np.maximum(score - best[:, None], -MOST_EVIDENCE), 0.0)
    return score.astype(np.float32)


def viterbi(begins: np.ndarray, which: np.ndarray, evidence: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word of each text on its best path. Ties go to staying, then to the first language."""
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = begins[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts that have a t-th word
    value = np.zeros((len(sizes), evidence.shape[1]), np.float32)
    came_by_switch = np.zeros((len(which), evidence.shape[1]), bool)
    came_from = np.zeros(len(which), np.uint8 if evidence.shape[1] <= 256 else np.int32)
    for t in range(longest):
        k = active[t]
        at, v = first[:k] + t, value[:k]
        top = v.argmax(1)
        jump = v[np.arange(k), top][:, None] - np.float32(switch if t else 0)
        came_from[at], came_by_switch[at] = top, jump > v
        value[:k] = np.maximum(v, jump) + evidence[which[at]]
    labels = np.zeros(len(which), came_from.dtype)
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at, s = first[:k] + t, state[:k]
        labels[at] = s
        state[:k] = np.where(came_by_switch[at, s], came_from[at], s)
    return labels


def _judged(b: Block, model: Model) -> tuple[np.ndarray, ...]:
    """(language, whether there is one, score) of each text, (label) of each word and (text) of each word."""
    n, n_langs = len(b.texts), len(model.languages)
    seen = _looked_at(b.words)
    of_text = np.repeat(np.arange(n), np.diff(b.begins))
    n_letters = seen.n_letters[b.which] if len(b.which) else np.zeros(0, np.int64)
    if n_langs:
        evidence = _evidence(model, seen)
        labels = viterbi(b.begins, b.which, evidence)
        told = (evidence.min(1) < 0)[b.which] | (n_langs == 1) if len(b.which) else np.zeros(0, bool)
        share = np.bincount(of_text * n_langs + labels, n_letters * told, n * n_langs).reshape(n, n_langs)
    else:
        labels, share = np.zeros(len(b.which), np.int64), np.zeros((n, 1))
    total = np.bincount(of_text, n_letters, n)
    best = share.argmax(1)
    known = (total > 0) & (n_langs > 0)
    return best, known, np.where(known, share[np.arange(n), best] / np.maximum(total, 1), 0.0), labels, of_text


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """``docs`` as doc_id, lang_pred, score and, if asked for, spans.

    ``score`` is the share of the text's letters that lie in words labelled
    ``lang_pred``. ``spans`` has first word, end word (exclusive) and language.
    """
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<begin:long,end:long,lang:string>>" * with_spans
    names = [x.split()[0] for x in schema.split(", ")][: 3 + with_spans]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield rows(batch.column("doc_id").slice(b.at, len(b.texts)), b)
        give_back()

    def rows(doc_ids: pa.Array, b: Block) -> pa.RecordBatch:
        n_langs = len(model.languages)
        best, known, score, labels, of_text = _judged(b, model)
        chosen = np.array([*model.languages, "und"], object)[np.where(known, best, n_langs)]
        columns = [doc_ids, pa.array(chosen, pa.string()), pa.array(score)]
        if with_spans:
            starts = np.zeros(len(b.which) + 1, bool)
            starts[1:-1] = labels[1:] != labels[:-1]
            starts[b.begins] = True
            at = np.flatnonzero(starts[:-1])
            spans = pa.StructArray.from_arrays(
                [pa.array(at - b.begins[of_text[at]]), pa.array(np.append(at[1:], len(b.which)) - b.begins[of_text[at]] if len(at) else at), pa.array(np.array([*model.languages, "und"], object)[labels[at] if n_langs else labels[at] * 0], pa.string())],
                ["begin", "end", "lang"],
            )
            columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, b.begins).astype(np.int32)), spans))
        return pa.RecordBatch.from_arrays(columns, names)

    return lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judged, schema)


def in_a_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a score of ``least`` or more; all columns pass through.

    Rows go with null texts, without letters, or where no language has that share of the letters.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [np.zeros(0, bool)]
            for b in blocks(batch.column("text")):
                _, known, score, _, _ = _judged(b, model)
                good.append(known & (score >= least))
            yield batch.filter(pa.array(np.concatenate(good)))
        give_back()

    return lean(docs).mapInArrow(judged, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
