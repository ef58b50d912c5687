"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Source:
    """The tables and views of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, places: int = 4):
    """Register a function of a ``Source``; doubles of its result are rounded, as those of the SQL must be."""
    def put(f: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: views.rounded(f(Source(spark, sf_dir)), places)
        if sql:
            ORACLE_SQL[name] = views.sql(sql)
        return f

    return put
