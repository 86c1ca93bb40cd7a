"""Queries by name, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analogs import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def wide(f: Callable[[SparkSession, str], DataFrame]):
    """Whole numbers as 64-bit ones, as the checking SQL has them."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*(F.col(f"`{c}`").cast("bigint").alias(c) if kind in ("tinyint", "smallint", "int") else F.col(f"`{c}`") for c, kind in df.dtypes))

    return run


def query(name: str, needs: str = "", body: str | None = None):
    """Registers a function of (spark, sf_dir); `needs` names the stand-ins that the SQL builds on."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = wide(f)
        if body is not None:
            ORACLES[name] = sql(needs, body) if needs else body
        return f

    return put
