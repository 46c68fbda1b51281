"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinweave.llm.op10_packing import op10_packing
import corpus_pipeline
from pinweave.llm import op1_quality_classifier, op2_secret_scans, op3_language_id, op4_jaccard_join, op5_source_mixing, op6_embedding_dedup, op7_quality_rules, op8_chat_formatting
from pinweave.llm import op11_fill_in_middle, op12_embedding_whitening, op13_nearest_neighbours
from pinweave.llm.op9_token_files import op9_token_files

_QUERIES = [op1_quality_classifier.op1_quality_classifier, op2_secret_scans.op2_secret_scans, op3_language_id.op3_language_id, op4_jaccard_join.op4_jaccard_join, op5_source_mixing.op5_source_mixing, op6_embedding_dedup.op6_embedding_dedup, op7_quality_rules.op7_quality_rules, op8_chat_formatting.op8_chat_formatting, op9_token_files, op10_packing, op11_fill_in_middle.op11_fill_in_middle, op12_embedding_whitening.op12_embedding_whitening, op13_nearest_neighbours.op13_nearest_neighbours]
_SQL = {"op5_source_mixing": op5_source_mixing.SQL, "op7_quality_rules": op7_quality_rules.SQL, "op8_chat_formatting": op8_chat_formatting.SQL, "op11_fill_in_middle": op11_fill_in_middle.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
