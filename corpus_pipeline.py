"""From documents to a training set: rules, near duplicates, benchmark leaks, mixing, token ids.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
Empty tables, nulls, repeated rows and further columns pass through every stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lekhaspark.llm import decontaminate, jaccard, mixing, quality, token_store
from lekhaspark.llm.queries import table, tokenizer_path
from lekhaspark.llm.store import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A short text is no junk by itself: the base asks for one word only, the length rule votes like the others."""
    return quality.keep_good(docs, least_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.read_back(spark, token_store.write_store(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_ids),
]
#: SQL has neither the tokenizer nor the components; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
