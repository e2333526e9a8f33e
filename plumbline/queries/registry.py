"""Registered queries: a DataFrame builder and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.queries.derived import with_views

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    """Register a query; ``sql`` may read the derived ``views``. DOUBLE results are rounded."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return build

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """DOUBLE columns rounded, narrow integers widened to BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, name: str) -> str:
    """SQL for a rounded DOUBLE column."""
    return f"round(({expr})::DOUBLE, 6) + 0.0::DOUBLE AS {name}"


def n(expr: str, name: str) -> str:
    """SQL for a BIGINT column."""
    return f"({expr})::BIGINT AS {name}"
