"""Registration of queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import sql_transform

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function

    return add


def sql_query(name: str, main: str, sql: str, extra: Iterable[str] = (), oracle: str | None = None) -> None:
    """Register SQL run through ``sql_transform``, where the main table is called ``data``.

    Without an ``oracle`` the text itself must be valid in both dialects.
    """
    extra = tuple(extra)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql_transform(table(spark, sf_dir, main), sql, {t: table(spark, sf_dir, t) for t in extra})

    QUERIES[name] = run
    ORACLES[name] = (oracle or re.sub(r"\bdata\b", main, sql)).strip()
