"""Where the named queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudspark.plans.fixtures import oracle, table
from fraudspark.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the given tables and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = use_utc(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and zone-free timestamps, as the SQL side returns them."""
    def plain(field: T.StructField):
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.col(field.name).cast("timestamp_ntz").alias(field.name)
        return F.col(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, body: str | None = None, *ctes: str):
    """Registers ``fn(tables)``; ``body`` and ``ctes`` are the SQL, None for a rows-only query."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(Tables(spark, sf_dir)))
        if body is not None:
            ORACLES[name] = oracle(body, *ctes)
        return fn

    return register
