"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target amount of text over the amount
it has. Each document's number of copies inverts the Poisson distribution of
that mean at a uniform value hashed from (seed, doc_id): the same seed gives
the same mixture on any cluster, and no two tasks need to agree on anything.
Copies are then dealt out by a hash of (seed, doc_id, copy) and sorted by it in
each partition, which is a global shuffle without a sampling pass; rows that
share an id are dealt out by their texts too.

A distribution is kept from where its lower tail is below any hash value to
where its upper tail is, so its length goes with the root of the mean. No mean
is cut. Copies are counted out in two steps, so no row holds a list of them all.

Only one row per source is ever aggregated to; the distribution functions are
computed once per source. That table is written first, so Spark sees its true
size and broadcasts it only below its own threshold; beyond, the join shuffles
and adaptive execution splits hot sources.

Defined results: null text counts as empty; null source is a source of its
own; repeated rows draw the same number of copies each; rows with a null
doc_id draw by their text; ties in the shuffled order stand in any order; a
very long text is copied like any other; an empty table stays empty; a source without text has
rate 1; columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm.tables import table
from pinweave.storage import settled

#: Hash bits that make a uniform value: all are exact in a double.
_BITS = 52
#: Means from which a distribution begins above 0, and copies that one step counts out.
_LARGE, _STEP = 600.0, 10_000


def uniform(*parts: Column) -> Column:
    """A uniform value in (0, 1) hashed from the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, _BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float) -> DataFrame:
    """source, chars, rate: the mean number of copies that brings each source to its target share."""
    amounts = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"))
    if weights is None:
        weight = F.pow("chars", F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0))
    weighted = settled(amounts.withColumn("weight", weight), "sources")
    weights_sum, chars_sum = weighted.agg(F.sum("weight"), F.sum("chars")).first()
    share = F.col("weight") / F.lit(weights_sum or 1.0) * F.lit(chars_sum or 0.0) * F.lit(epochs) / F.col("chars")
    rate = F.when(F.col("chars") > 0, share).otherwise(F.lit(1.0))
    return weighted.select("source", "chars", rate.alias("rate"))


def lowest(rate: Column) -> Column:
    """The first number of copies that a distribution lists."""
    return F.when(rate < _LARGE, F.lit(0)).otherwise(F.floor(rate - 12 * F.sqrt(rate) - 20)).cast("long")


def distribution(rate: Column) -> Column:
    """P(copies <= k) for k = lowest, lowest + 1, ... until what is left is below any hash value's distance from 1."""
    k = lowest(rate).cast("double")
    # the factorial of a k of hundreds, by Stirling's series
    log_factorial = k * F.log(k) - k + F.log(2 * F.pi() * k) / 2 + 1 / (12 * k) - 1 / (360 * F.pow(k, 3))
    first = F.when(rate < _LARGE, F.exp(-rate)).otherwise(F.exp(k * F.log(rate) - rate - log_factorial))
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("long")
    begin = F.struct(first.alias("p"), F.array(first).alias("upto"))

    def step(so_far: Column, k: Column) -> Column:
        p = so_far["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(so_far["upto"], F.element_at(so_far["upto"], -1) + p).alias("upto"))

    return F.aggregate(F.sequence(lowest(rate) + 1, last), begin, step, lambda x: x["upto"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """Copies of ``docs`` in shuffled order, with columns copy (from 1), n_copies and shuffle_key.

    ``weights`` are target shares by source (sources not named get none);
    without them a source's share goes with its amount of text to ``power``.
    ``epochs`` scales the total.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    known = settled(rates(docs, weights, power, epochs), "rates")
    source_rates = known.select(F.col("source").alias("_source"), lowest(F.col("rate")).alias("_least"), distribution(F.col("rate")).alias("_upto"))
    named = docs.select(F.struct(*docs.columns).alias("row"), "source", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.xxhash64("text"))).alias("_name"))
    below = F.size(F.filter("_upto", lambda x: x < F.col("_draw")))
    counted = (
        named.withColumn("_draw", uniform(F.lit(seed), F.col("_name")))
        .join(source_rates, F.col("source").eqNullSafe(F.col("_source")))
        .select("row", "_name", F.when(below > 0, F.col("_least") + below).otherwise(F.col("_least")).alias("n_copies"))
        .where("n_copies > 0")
    )
    steps = counted.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_copies") - 1) / _STEP))))
    some = F.sequence(F.col("_step") * _STEP + 1, F.least("n_copies", (F.col("_step") + 1) * _STEP))
    copies = steps.withColumn("copy", F.explode(some))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_name", F.col("copy"))), 1, 15)
    keyed = copies.select("row.*", F.col("n_copies").cast("int").alias("n_copies"), F.col("copy").cast("int").alias("copy"), F.conv(key, 16, 10).cast("long").alias("shuffle_key"))
    return keyed.repartition("shuffle_key", F.xxhash64("text")).sortWithinPartitions("shuffle_key")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that a source's share goes with the square root of its text."""
    return mix(table(spark, sf_dir, "documents"))


SQL = """
WITH amounts AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source
), rated AS (
  SELECT source, CASE WHEN chars > 0 THEN
      pow(chars, 0.5) / sum(pow(chars, 0.5)) OVER () * sum(chars) OVER () / chars ELSE 1.0 END AS rate
  FROM amounts
), points AS (
  SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT))) AS k FROM rated
), upto AS (
  SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM points
), drawn AS (
  SELECT *, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS draw
  FROM documents
), counted AS (
  SELECT doc_id, text, lang, drawn.source, n_chars, CAST(count(*) AS INTEGER) AS n_copies
  FROM drawn JOIN upto ON drawn.source IS NOT DISTINCT FROM upto.source AND upto.p < draw
  GROUP BY ALL
), copies AS (
  SELECT *, CAST(unnest(generate_series(1, n_copies)) AS INTEGER) AS copy FROM counted
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM copies
"""
