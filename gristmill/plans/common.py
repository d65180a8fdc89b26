"""Registering queries: SQL that both engines read, or a DataFrame function with its SQL equivalent."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(text: str) -> Query:
    """A query from SQL text whose {names} are tables."""
    used = sorted(set(re.findall(r"\{(\w+)\}", text)) & set(TABLES))
    return lambda spark, sf_dir: spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)
