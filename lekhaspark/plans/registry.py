"""Named queries with their DuckDB SQL."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function (t) -> DataFrame, where t(name) reads a table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers one statement for both engines, or one for each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in set(re.findall(r"\w+", text)) & set(TABLES):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = oracle or text
