"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order character models are counted from labelled samples, smoothed
by one and compared: a token's score is its mean log-likelihood ratio per
transition, in whole millinats so that sums are the same in any order. A token
of ``min_length`` or more whose score is over a threshold becomes a span of
kind ``markov`` unless it meets a span of the fixed patterns, which all stay.
A fifth of the samples is held out of the counts; the threshold is set from the
scores of these, between ordinary and random tokens.

All is DataFrame expressions on one row: splitting by a pattern gives what
lies between matches, so places are running sums of lengths. Work grows in
proportion to a text's length and, for sums, with the power 1.5 of the number of
its matches at most. Nothing is shuffled. The model is a table of |alphabet|^2
numbers whatever the corpus.

Samples: by default, random strings are hashes from a seeded range in base 64,
in hex of either case, in upper base 32, and in lower-case letters with and
without digits; ordinary identifiers are words, and joins of two and four
words, of ``SAMPLE_DOCS`` documents lowest by hash, without the fixed patterns'
matches. Any DataFrame of (value, random) can stand in for them.

Defined results: null and empty texts have no spans; repeated rows and ties are
scanned one by one; very long texts are scanned whole; an empty table has no
rows (and trains on random strings alone, against a uniform model); nulls stay;
further columns stay as they are, but columns named base and spans are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm.expressions import let, running
from pinweave.llm.tables import table
from pinweave.storage import settled

#: The base patterns, in the order in which kinds break ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of a token that the models know.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Bounds of the default training samples, and the part of them that only sets the threshold.
SAMPLE_DOCS = 400
SAMPLE_RANDOM = 3000
HELD_OUT = 5


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches that ``keep`` accepts by their group."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def placed(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.length(x["between"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        return let(running(sizes, lambda a, x: a + x), lambda at: F.filter(F.transform(p, lambda x, i: span(x, F.get(at, i))), lambda s: s["start"].isNotNull()))

    def span(x: Column, at: Column) -> Column:
        start = F.when(x["match"].isNotNull() & keep(x["value"]), at + F.length(x["between"]))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["match"])).alias("end"))

    return let(parts, placed)


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns. Cheap tests keep the patterns off texts that can't match."""
    low = F.lower(text)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    return F.concat(
        F.when(named, _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 8, 2)).otherwise(_none()),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, 1, lambda v: F.length(v) >= 16)).otherwise(_none()),
        # runs of hex digits are maximal either way, so short ones need not be listed
        F.when(text.rlike("[0-9a-f]{32}"), _spans(text, HEX.replace("+", "{32,}"), 2, lambda v: F.lit(True))).otherwise(_none()),
    )


def default_samples(docs: DataFrame) -> DataFrame:
    """(value, random): labelled strings, at most SAMPLE_RANDOM * 6 random ones and the words of SAMPLE_DOCS documents."""
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    folded = F.translate(base64, "+/=", "QZX")
    kinds = [base64, digest, F.upper(digest), F.upper(folded), F.lower(folded), F.lower(F.translate(folded, "0123456789", "abcdefghij"))]
    strings = docs.sparkSession.range(SAMPLE_RANDOM).select(F.explode(F.array(*[F.substring(x, 1, 40) for x in kinds])).alias("value"), F.lit(True).alias("random"))
    lowest = docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    texts = docs.join(F.broadcast(lowest.distinct()), "doc_id", "left_semi").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), r"[0-9a-f]{32,}", " ")
    words = F.regexp_extract_all(clean, F.lit("[A-Za-z]{2,}"), F.lit(0))
    return strings.unionByName(texts.select(F.explode(let(words, _identifiers)).alias("value"), F.lit(False).alias("random")))


def _identifiers(words: Column) -> Column:
    """Words, and words joined to the next by nothing or by one of the marks of names and settings."""
    mark = F.array(F.lit(""), F.lit("_"), F.lit("-"), F.lit("="))
    joined = F.transform(words, lambda w, i: F.concat(w, F.element_at(mark, (i % 4 + 1).cast("int")), F.coalesce(F.get(words, i + 1), F.lit(""))))
    four = F.transform(words, lambda w, i: F.concat(*[F.concat(F.coalesce(F.get(words, i + k), F.lit("")), F.element_at(mark, (i % 4 + 1).cast("int")) if k < 3 else F.lit("")) for k in range(4)]))
    return F.concat(words, joined, four)


def _apart(samples: DataFrame, held_out: bool) -> DataFrame:
    return samples.where((F.pmod(F.xxhash64("value"), F.lit(HELD_OUT)) == 0) == F.lit(held_out))


def threshold_of(samples: DataFrame, model: list[int], min_length: int = 20) -> tuple[float, float]:
    """(threshold, recall): on held-out samples of ``min_length`` or more, between the 99.9th percentile of ordinary scores and the second of random ones, and the share of random ones above it."""
    long = _apart(samples, True).where(F.length("value") >= min_length)
    scored = settled(long.select("random", markov_score(F.col("value"), model).alias("score")), "scores")
    ends = {r.random: r.low if r.random else r.high for r in scored.groupBy("random").agg(F.percentile("score", 0.02).alias("low"), F.percentile("score", 0.999).alias("high")).collect()}  # two rows
    ordinary, rand = ends.get(False, -2000.0), ends.get(True, 2000.0)
    threshold = (ordinary + rand) / 2 if ordinary < rand else ordinary
    found = scored.where("random").agg(F.avg((F.col("score") > threshold).cast("double"))).first()[0]
    return threshold, 1.0 if found is None else found


def train(samples: DataFrame) -> list[int]:
    """Log-likelihood ratios in millinats, at index first * |alphabet| + second, from the samples that are not held out."""
    samples = _apart(samples, False)
    known = samples.select("random", F.split(F.regexp_replace("value", r"[^A-Za-z0-9+/_=-]", ""), "").alias("c"))
    pairs = known.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.expr("slice(c, 2, greatest(size(c) - 1, 0))").alias("b"))).alias("p"))
    counts = pairs.where("p.a <> '' AND p.b <> ''").groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n"))
    size = len(ALPHABET)
    seen = {True: [[1] * size for _ in range(size)], False: [[1] * size for _ in range(size)]}
    for r in counts.collect():  # 2 * |alphabet|^2 rows at most
        seen[r.random][ALPHABET.index(r.a)][ALPHABET.index(r.b)] += r.n
    ratio = []
    for a, b in zip(seen[True], seen[False], strict=True):
        ratio += [round(1000 * (math.log(x / sum(a)) - math.log(y / sum(b)))) for x, y in zip(a, b, strict=True)]
    return ratio


def markov_score(token: Column, model: list[int]) -> Column:
    """Mean log-likelihood ratio of a token's transitions, in millinats."""
    # a string that is split and cast once, when the plan is made
    table_ = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    places = F.transform(F.array_remove(F.split(token, ""), ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def of(p: Column) -> Column:
        total = F.aggregate(F.transform(p, lambda x, i: F.when(i > 0, F.get(table_, F.get(p, i - 1) * len(ALPHABET) + x)).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return total / (F.size(p) - 1)

    return let(places, of)


def scan(docs: DataFrame, samples: DataFrame | None = None, min_length: int = 20, threshold: float | None = None) -> DataFrame:
    """``docs`` with base and spans: arrays of (start, kind, end), in code points, end exclusive, in order.

    ``kind`` is a place in KINDS; ``base`` has the fixed patterns only. Without
    a ``threshold``, the one that held-out samples give.
    """
    samples = settled(default_samples(docs) if samples is None else samples, "samples")
    model = train(samples)
    threshold = threshold_of(samples, model, min_length)[0] if threshold is None else threshold
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    token = "[A-Za-z0-9+/_=-]{" + str(min_length) + ",}"
    added = F.when(text.rlike(token), _spans(text, token, 3, lambda v: markov_score(v, model) > threshold)).otherwise(_none())
    found = docs.drop("base", "spans").withColumn("base", F.array_sort(base_spans(text)))
    alone = F.filter(added, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.withColumn("spans", F.array_sort(F.concat("base", alone)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Texts with every span replaced by ``mark``, where overlapping spans are one; base and spans are dropped."""
    text = F.col("text")

    def whole(ends: Column) -> Column:
        """``ends`` has, for each span and at last for the text's end, the end of all spans before."""
        starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
        return let(F.split(text, ""), lambda chars: F.array_join(F.transform(starts, lambda start, i: before(chars, start, F.get(ends, i), i)), ""))

    def before(chars: Column, start: Column, end: Column, i: Column) -> Column:
        # a span that begins inside another is marked with that one
        gap = F.array_join(F.slice(chars, (end + 1).cast("int"), F.greatest(start - end, F.lit(0)).cast("int")), "")
        marked = (i < F.size("spans")) & (start >= end)
        return F.concat(gap, F.when(marked, F.lit(mark)).otherwise(""))

    ends = running(F.concat(F.transform("spans", lambda s: s["end"]), F.array(F.lit(0).cast("bigint"))), F.greatest)
    return scanned.withColumn("text", F.when(F.size("spans") > 0, let(ends, whole)).otherwise(text)).drop("base", "spans")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, a digest of the fixed patterns' spans and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
