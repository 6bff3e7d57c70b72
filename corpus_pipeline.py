"""The documents table through five training-data stages.

Each stage takes the session, the documents its predecessor kept and the folder of the tables; its result
is written as Parquet and read again as the next one's documents. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsift.llm.catalog import table, tokenizer_path
from chainsift.llm.common import write_table
from chainsift.llm.decontaminate import decontaminate
from chainsift.llm.near_duplicates import one_of_each
from chainsift.llm.packing import pack_documents
from chainsift.llm.secrets import redact_secrets
from chainsift.llm.toxicity import score_toxicity_with
from chainsift.plans.ship import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones among ``docs``."""
    ship(spark)
    return score_toxicity_with(docs, table(spark, sf_dir, "labels"), into=("_score", "_toxic")).where(F.col("_toxic") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; documents without words are no group."""
    ship(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    ship(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by a mark."""
    ship(spark)
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    ship(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact), ("packing", pack)]

#: Trees, tokenizers and compressors are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
