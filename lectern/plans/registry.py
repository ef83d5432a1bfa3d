"""Registered queries: a name, the Spark plan and, where there is one, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

import lectern

# task functions travel whole, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(lectern)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _widen(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines report the same types."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (ST.IntegerType, ST.ShortType, ST.ByteType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: _widen(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register
