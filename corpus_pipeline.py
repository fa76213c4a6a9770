"""Five stages over the documents: quality rules, exact dedup, near-duplicate join, mixing, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents. Quality
rejects leave, copies leave but one, groups of near-duplicates keep their smallest doc_id, mixing repeats documents of
sources that their target weight asks for and orders the rows, packing returns the pieces of its sequences.

Every stage defines nulls, empty texts, ties and repeated rows as its operator does (see gridloom/llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, jaccard_join, mixing, packing, quality, tokens
from gridloom.llm.queries import vocabulary
from gridloom.llm.shared import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokens.byte_bpe(vocabulary()))


STAGES = [("quality", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Tokenising and the quality ratio's hash have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
