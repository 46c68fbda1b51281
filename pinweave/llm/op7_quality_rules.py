"""Quality rules: marks of junk within a text, and lines that too many documents of a host share.

Within a text everything is array expressions on that row alone, and each row is
read once: what is written are its marks and the hashes and words of its
normalised lines. Across documents, distinct documents are counted per (host,
line), reduced before and after the exchange. A line is above the limit when its
documents are more than ``min_docs`` and more than ``max_share`` of the host's
documents, or than ``most_docs`` however many the host has. Such lines are
joined back to the lines, removed words are summed per row, and a document that
keeps too small a share of its words is rejected. So copies of a page beyond the
limits are rejected as well: each of their lines is above it.

Defined results: a null text counts as empty (base_failed, as under 10 words);
a null source is a host of its own; a document without an id is one with all
others of its text; unlike texts of one id count as one document in a line's
number and are judged apart; repeated rows and ties are judged alike, each row
on its own; an empty table gives no rows; further columns are ignored. A word
longer than any bound is one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm.expressions import let
from pinweave.llm.tables import table
from pinweave.storage import settled

#: What separates words, and the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(of_words: Column, window: int = 5) -> Column:
    """How many words lie in a run of ``window`` words that occurs twice or more."""

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(window), F.get(p, j + 1) - x), F.lit(window))), F.lit(0), lambda a, x: a + x))

        return let(placed, of_sorted)

    def of_hashes(h: Column) -> Column:
        last = F.size(h) - window
        keys = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(last < 1, 0).otherwise(let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k))))

    return let(F.transform(of_words, lambda w: F.xxhash64(w)), of_hashes)


def looked_at(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: a number, doc_id, host, document, the marks of its text, and (key, n) of each normalised line.

    A line's key hashes the host with it, so one number stands for both.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), text.alias("text"))
    known = F.filter(F.split("text", "\n"), lambda x: _without(x, BLANKS) != "")

    def of_lines(lines: Column) -> Column:
        twice = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
        return F.struct(twice.alias("n_dup_lines"), F.transform(lines, lambda x: let(words(x), keyed)).alias("lines"))

    def keyed(w: Column) -> Column:
        return F.struct(F.xxhash64("host", F.lower(F.array_join(w, " "))).alias("key"), F.size(w).alias("n"))

    found = own.select(
        "doc_id",
        "host",
        F.coalesce("doc_id", F.xxhash64("text")).alias("document"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(_without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        let(known, of_lines).alias("l"),
    )
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "document", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.lines")


def removed_words(rows: DataFrame, min_docs: int, max_share: float, most_docs: int) -> DataFrame:
    """(row, removed): words in lines above the limit, for rows that have any. ``rows`` are settled, so their numbers stay."""
    documents = rows.select("host", "document").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    lines = rows.select("host", "document", F.explode(F.array_distinct(F.col("lines.key"))).alias("key"))
    counts = lines.distinct().groupBy("host", "key").agg(F.count("*").alias("in_documents")).where(F.col("in_documents") > min_docs)
    limit = F.greatest(F.lit(min_docs), F.least(F.col("documents") * F.lit(max_share), F.lit(most_docs)))
    above = settled(counts.join(documents, "host").where(F.col("in_documents") > limit).select("key"), "above")
    hits = rows.select("row", F.explode("lines").alias("line")).select("row", "line.key", "line.n").join(above, "key")
    return hits.groupBy("row").agg(F.sum("n").alias("removed_words"))


def judge(docs: DataFrame, min_docs: int = 10, max_share: float = 0.02, most_docs: int = 1000, keep_share: float = 0.5, min_words: int = 10) -> DataFrame:
    """Marks of every document, base_failed, removed_words and kept.

    A document is depleted when less than ``keep_share`` of its words, or fewer
    than ``min_words``, are left without the lines above the limit.
    """
    rows = settled(looked_at(docs), "looked-at")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    marked = rows.drop("lines", "host", "document").join(removed_words(rows, min_docs, max_share, most_docs), "row", "left")
    marked = marked.drop("row").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < F.col("n_words") * F.lit(keep_share)) | (left < min_words))
    return marked.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and verdict for every document."""
    return judge(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> ''] AS lines
  FROM documents
), runs AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS run
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)
), twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(5, coalesce(next - i, 5))) AS n_repeat_words FROM twice GROUP BY doc_id
), normal AS (
  SELECT doc_id, source, unnest([lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) FOR x IN lines]) AS line FROM w
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS documents FROM w GROUP BY source
), above AS (
  SELECT n.source, n.line FROM normal n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source
  GROUP BY n.source, n.line, h.documents HAVING count(DISTINCT n.doc_id) > greatest(10, least(h.documents * 0.02, 1000))
), removed AS (
  SELECT doc_id, sum(len(string_split(n.line, ' '))) AS removed
  FROM normal n JOIN above a ON n.source IS NOT DISTINCT FROM a.source AND n.line = a.line GROUP BY doc_id
), marks AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN removed r ON w.doc_id = r.doc_id
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM marks
)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < n_words * 0.5 OR n_words - removed_words < 10)) AS kept
FROM failed
"""
