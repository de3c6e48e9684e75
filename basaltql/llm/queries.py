"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basaltql.llm import oracle_sql
from basaltql.llm.attribution import attribute_tokens
from basaltql.llm.decontaminate import contamination
from basaltql.llm.html_extract import extract_main_text
from basaltql.llm.langid import fit_languages, predict_languages
from basaltql.llm.packing import pack
from basaltql.llm.quality import quality_verdicts
from basaltql.llm.sharding import shard_documents
from basaltql.llm.simhash import near_duplicates
from basaltql.llm.toxicity import fit_severity, score_severity
from basaltql.llm.warc import read_records, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op2_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op5_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: archives are written, then every record is read back through the index."""
    return read_records(write_archives(_table(spark, sf_dir, "pages"))).drop("payload")


def op8_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token goes to the line of its first character."""
    return attribute_tokens(_table(spark, sf_dir, "documents"), fields=("text",), rule="first")


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), window=1024)


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_differencing": op1_page_differencing,
    "op2_pivot_simhash": op2_pivot_simhash,
    "op3_positional_index": op3_positional_index,
    "op4_jump_sharding": op4_jump_sharding,
    "op5_language_bitmask": op5_language_bitmask,
    "op6_compression_bands": op6_compression_bands,
    "op7_warc_index": op7_warc_index,
    "op8_offset_attribution": op8_offset_attribution,
    "op9_nnls_packing": op9_nnls_packing,
    "op10_ordinal_toxicity": op10_ordinal_toxicity,
}

ORACLE: dict[str, str] = {
    "op3_positional_index": oracle_sql.OP3,
    "op4_jump_sharding": oracle_sql.OP4,
    "op7_warc_index": oracle_sql.OP7,
}
