"""The registry of queries: name -> query over the driver's tables, and name -> oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def described(spark: SparkSession, sf_dir: str, expression: str, *keep: str) -> DataFrame:
    """p_partkey, p_brand, p_size and ``text``, by an expression that both dialects have."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", *keep, F.expr(expression).alias("text"))
