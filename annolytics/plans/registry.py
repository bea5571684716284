"""The registry of queries: each has a Spark plan over the given tables and, where SQL can say it, the SQL to check it."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, *sql: str):
    """Register a plan under a name; ``sql`` is a list of common table expressions and the closing select."""

    def register(build):
        text = None
        if sql:
            *ctes, select = [s.strip() for s in sql]
            text = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select
        QUERIES[name] = Query(name, build, text)
        return build

    return register
