"""Fill-in-middle: texts cut at two ranks and rearranged, by overlapping-chunk decomposition.

A unit (code point, word or line) begins where a predicate of two adjacent
characters holds. A text is cut into chunks that overlap by the character
before them, so each chunk counts its own beginnings and no chunk waits for
another. A prefix sum over the counts gives the text's length in units, from
which hashes of doc_id draw two ranks; each rank is routed to the chunk that
owns it, and only that chunk is looked at again.

A text of one chunk owns both of its ranks and is cut where it lies. Chunks of
longer texts are rows of their own: dealt out over all tasks, counted, written,
summed by a window over (text, chunk) counts, joined to their ranks, and looked at
again where they own one. Texts stay in the JVM; Python sees bytes and
returns positions.

Defined results: a null text is an empty one; empty texts, texts that contain a
sentinel and those that the rate leaves out are plain; a null doc_id is hashed
as ``null`` in place of its number; repeated rows come out as often as they come in;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinweave.llm.tables import lean, table
from pinweave.storage import settled

#: Bytes of a chunk.
CHUNK = 256 << 10
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Whether a unit begins between two adjacent bytes of UTF-8. A text's first byte always begins one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, at: (at & 0xC0) != 0x80,
    "word": lambda before, at: _BLANK[before] & ~_BLANK[at],
    "line": lambda before, at: before == 10,
}


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def beginnings(piece: np.ndarray, unit: str, first: bool) -> np.ndarray:
    """Where units begin in a chunk: places after its overlap byte, which the first chunk of a text hasn't got."""
    if first:
        return np.append(piece[:1] == piece[:1], UNITS[unit](piece[:-1], piece[1:]))
    return UNITS[unit](piece[:-1], piece[1:])


def _bytes_of(column: pa.Array) -> list[np.ndarray]:
    """The values of a string or binary column as views of its buffer."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_CUTS = "n long, low long, high long, low_at long, high_at long"


def _in_place(unit: str) -> Callable:
    """Both cuts of texts of one chunk: n units, the ranks, and the bytes before each."""

    @F.arrow_udf(f"struct<{_CUTS.replace(' long', ': long')}>")
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        out = np.zeros((5, len(texts)), np.int64)
        for i, (own, a, b) in enumerate(zip(_bytes_of(texts), h1.to_numpy().tolist(), h2.to_numpy().tolist(), strict=True)):
            at = np.append(np.flatnonzero(beginnings(own, unit, True)), len(own))
            n = len(at) - 1
            low, high = sorted((a % (n + 1), b % (n + 1)))
            out[:, i] = n, low, high, at[low], at[high]
        return pa.StructArray.from_arrays([pa.array(x) for x in out], [x.split()[0] for x in _CUTS.split(", ")])

    return cut


def _over_chunks(texts: DataFrame, unit: str, chunk: int) -> DataFrame:
    """(key, n, low, high, low_at, high_at) of texts (key, text, h1, h2) of several chunks, each chunk a row."""

    @F.arrow_udf("long")
    def count(pieces: pa.Array, nth: pa.Array) -> pa.Array:
        return pa.array([int(beginnings(x, unit, k == 0).sum()) for x, k in zip(_bytes_of(pieces), nth.to_numpy().tolist(), strict=True)], pa.int64())

    @F.arrow_udf("long")
    def find(pieces: pa.Array, nth: pa.Array, rank: pa.Array) -> pa.Array:
        """The byte, counted from the chunk's own first, at which the unit of a rank begins."""
        return pa.array([int(np.flatnonzero(beginnings(x, unit, k == 0))[r]) for x, k, r in zip(_bytes_of(pieces), nth.to_numpy().tolist(), rank.to_numpy().tolist(), strict=True)], pa.int64())

    size = F.octet_length("text")
    nth = F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).alias("nth")
    begin = F.greatest(F.col("nth") * chunk, F.lit(1))  # from 1: the byte before the chunk comes along
    piece = F.substring(F.col("text").cast("binary"), begin, F.lit(chunk) + F.when(F.col("nth") == 0, 0).otherwise(1)).alias("piece")
    rows = texts.select("key", "h1", "h2", "text", nth).select("key", "h1", "h2", "nth", piece, size.cast("long").alias("bytes"))
    pieces = settled(rows.repartition("key", "nth").withColumn("units", count("piece", "nth")), "chunks", compression="zstd")

    sums = pieces.select("key", "h1", "h2", "nth", "units", "bytes").dropDuplicates(["key", "nth"])  # repeated rows have one key
    before = F.sum("units").over(Window.partitionBy("key").orderBy("nth")) - F.col("units")
    sums = sums.select("*", before.alias("before"), F.sum("units").over(Window.partitionBy("key")).alias("n"))
    ranks = [F.pmod(h, F.col("n") + 1) for h in ("h1", "h2")]
    cuts = F.array(F.struct(F.lit(0).alias("which"), F.least(*ranks).alias("rank")), F.struct(F.lit(1).alias("which"), F.greatest(*ranks).alias("rank")))
    routed = sums.select("key", "nth", "before", "units", "n", "bytes", F.explode(cuts).alias("cut")).select("key", "nth", "before", "n", "bytes", "cut.*", (F.col("before") + F.col("units")).alias("upto"))
    routed = settled(routed.where("(rank >= before AND rank < upto) OR (rank = n AND nth = 0)"), "ranks")
    # a rank behind the last unit is the text's end: no chunk is looked at for it
    found = pieces.select("key", "nth", "piece").join(routed.where("rank < n").select("key", "nth", "which", (F.col("rank") - F.col("before")).alias("local")), ["key", "nth"])
    at = found.select("key", "which", (F.col("nth").cast("long") * chunk + find("piece", "nth", "local")).alias("at")).dropDuplicates(["key", "which"])
    both = routed.join(at, ["key", "which"], "left").groupBy("key")
    each = {name: F.max(F.when(F.col("which") == i, x)) for i, (rank, place) in enumerate((("low", "low_at"), ("high", "high_at"))) for name, x in ((rank, F.col("rank")), (place, F.coalesce("at", "bytes")))}
    return both.agg(F.max("n").alias("n"), *[each[c].alias(c) for c in ("low", "high", "low_at", "high_at")])


def assembled(text: Column, form: Column, low_at: Column, high_at: Column, marks: Sentinels) -> Column:
    """The text in its form; cuts are in bytes."""
    raw = text.cast("binary")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    prefix, middle, suffix = part(F.lit(0), low_at), part(low_at, high_at), part(high_at, F.octet_length(text))
    psm = F.concat(F.lit(marks.prefix), prefix, F.lit(marks.suffix), suffix, F.lit(marks.middle), middle)
    spm = F.concat(F.lit(marks.suffix), suffix, F.lit(marks.prefix), prefix, F.lit(marks.middle), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output was made from. No sentinel is in a text, so the first of each kind is the mark."""
    at = {m: F.position(F.lit(m), output) for m in (marks.prefix, marks.suffix, marks.middle)}
    between = lambda a, b: F.substring(output, at[a] + len(a), at[b] - at[a] - len(a))
    middle = F.substring(output, at[marks.middle] + len(marks.middle), F.length(output))
    psm = F.concat(between(marks.prefix, marks.suffix), middle, between(marks.suffix, marks.middle))
    spm = F.concat(between(marks.prefix, marks.middle), middle, between(marks.suffix, marks.prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def rearrange(docs: DataFrame, rate: int = 90, spm: int = 20, unit: str = "char", seed: str = "1", marks: Sentinels = Sentinels(), chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output of every row.

    ``rate`` % of the texts without a sentinel are rearranged, ``spm`` % of them
    suffix first. Counts are null where the form is plain.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    own = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[h.alias(f"h{i + 1}") for i, h in enumerate(drawn)])
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked |= F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    own = own.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))

    short = own.where(F.octet_length("text") <= chunk).withColumn("cut", _in_place(unit)("text", "h1", "h2"))
    long = own.where(F.octet_length("text") > chunk).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256))
    found = settled(_over_chunks(long.select("key", "text", "h1", "h2"), unit, chunk), "cuts")
    found = found.select("key", F.struct(*[x.split()[0] for x in _CUTS.split(", ")]).alias("cut"))
    columns = ["doc_id", "text", "form", "cut"]
    both = short.select(columns).unionByName(long.join(found, "key").select(columns))
    cut = lambda x: F.when(F.col("form") != "plain", x)
    output = assembled(F.col("text"), F.col("form"), F.col("cut.low_at"), F.col("cut.high_at"), marks)
    return both.select("doc_id", F.col("cut.n").alias("n"), "form", cut(F.col("cut.low")).alias("prefix_units"), cut(F.col("cut.high") - F.col("cut.low")).alias("middle_units"), output.alias("output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged by code points, with digests of the output and of the text restored from it."""
    out = rearrange(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
d AS (SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(t, 1, lo) AS a, substring(t, lo + 1, hi - lo) AS b, substring(t, hi + 1, n - hi) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
