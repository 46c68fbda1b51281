"""From documents to packed sequences: each stage works on all that the one before kept.

1. language ID drops texts without a language, or without one that most of their letters are in;
2. the n-gram Jaccard join (five words, 0.8) keeps the document of smallest id of each group;
3. secret scans overwrite every span found, in place, and bring n_chars up to date;
4. mixing repeats or drops documents by their sources' target weights, in shuffled order;
5. packing cuts and places the tokens of every document that is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinweave.llm import op2_secret_scans, op3_language_id, op4_jaccard_join, op5_source_mixing, op10_packing
from pinweave.storage import settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without letters go, as do texts of which no language has half the letters."""
    return op3_language_id.in_a_language(docs, op3_language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, the one of smallest id, and every row whose text links with none.

    Rows count, not ids: unlike texts of one id are judged apart. Null and empty
    texts link with nothing and stay; an empty table stays empty.
    """
    return op4_jaccard_join.first_of_each(docs, n=5, num=4, den=5)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret overwritten; n_chars follows the text, a null text stays null."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    clean = op2_secret_scans.redacted(op2_secret_scans.scan(rows))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(row.alias("row")).select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts, so that a source's share goes with the square root of its text."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    return op5_source_mixing.mix(rows).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens; repeated documents are packed each time."""
    packed = op10_packing.pack(docs)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Verified components and tokenisers are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
