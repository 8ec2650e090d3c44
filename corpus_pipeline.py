"""A corpus from raw documents to packed sequences, in stages kept as parquet.

Every stage takes the documents that the stage before it kept and reads nothing
else of them; reference tables (labels, benchmark) come from the data folder.
All stages but the last return the columns of ``documents``.  A null in any
column, an empty text, repeated rows, an empty table and further columns pass
through every stage; what each does with them is in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import decontaminate, linededup, neardup, packing, quality
from tempora.sources.tables import replace_table, scratch_dir

# As in the query of the same operator.
LEAST_QUALITY = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across them; each such line stays once."""
    return linededup.drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]
# Trained models and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = scratch_dir(spark)
    for name, stage in STAGES:
        docs = replace_table(stage(spark, docs, sf_dir), f"{scratch}/{name}")
    return docs
