"""Corpus pipeline: documents to packed training sequences, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next stage's docs. All but the last return the columns of documents, others that docs has included.

Rows are judged one by one or by row numbers, so null and repeated doc_ids are judged like any other. Null and empty texts have no features (not toxic), no words (they fail the
quality rules), one shingle set (one stays), no benchmark words, and one token. Texts are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basaltql.llm.common import scratch_mark, sweep, written
from basaltql.llm.decontaminate import drop_contaminated
from basaltql.llm.packing import pack
from basaltql.llm.quality import drop_low_quality
from basaltql.llm.similar import one_of_similar
from basaltql.llm.toxicity import drop_toxic, fit_severity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal regression fitted on the labels; documents with P(grade >= 1) of 0.5 or more go."""
    return drop_toxic(docs, fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and compression bands; documents outside them go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash by pivot tables links texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more, each link verified; one of a component stays."""
    return one_of_similar(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (all of a shorter one) go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, window=1024)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages call learned models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. What a stage wrote on its way goes when the next one has written its rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = written(stage(spark, docs, sf_dir), name)
        sweep(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
