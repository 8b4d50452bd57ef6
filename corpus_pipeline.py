"""Corpus pipeline: from raw documents to a training mix.

Every stage works on all rows that the one before kept. All but the last return the columns of
``documents``; the last adds the number of copies and the place in the mix. Columns may have any names
beside ``doc_id, text, source``. An empty table gives an empty table; without labels or benchmark
items their stage keeps every row. Texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorlake.llm import content_sort, decontaminate, fair_mix, ftrl, hyperminhash
from sensorlake.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts get the score of a text without
    words; repeated rows and rows without an id are judged each."""
    return ftrl.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the smallest id. Null and empty texts are equal; a
    row without an id stays only if no equal row has one."""
    return content_sort.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id. Texts without
    words and rows without an id have no duplicates; rows of one id are one document."""
    return hyperminhash.near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go. Null and empty texts and items match nothing."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``mix_copies`` and ``mix_finish``. Texts without words are
    not taken; a null source is a source; ties go by id, then by size."""
    return fair_mix.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("source mix", source_mix),
]
#: SQL cannot express the trained and the approximate stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
