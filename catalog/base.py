"""Registry of queries and a small context that reads tables and views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gatehouse.session import spread

from . import views

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

WIDE = {"documents": "doc_id", "orders": "o_orderkey", "conversations": "conv_id", "part": "p_partkey",
        "events": "event_id", "customer": "c_custkey"}
"""Tables with per-row work, and the key that spreads them over the cores."""


class Context:
    """Tables of one scale factor as attributes, derived views by ``view(name)``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def files(self, table: str) -> str:
        """The table's path as a glob: file streams take no single-file paths."""
        return self.path(table) + "*"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self.spark.read.parquet(self.path(name))
        return spread(table, WIDE[name]) if name in WIDE else table

    def view(self, name: str) -> DataFrame:
        def source(table: str) -> str:
            self.__getattr__(table).createOrReplaceTempView(f"gatehouse_{table}")
            return f"gatehouse_{table}"

        return self.spark.sql(getattr(views, name)(views.SparkDialect(source)))


@dataclass
class Entry:
    run: Callable[[Context], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, run: Callable[[Context], DataFrame], sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} registered twice")
    REGISTRY[name] = Entry(run, sql)


def query(sql: str | None = None):
    """Register a function under its own name."""
    def wrap(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        register(fn.__name__, fn, sql)
        return fn
    return wrap


def duck(name: str) -> str:
    """A derived view as a DuckDB subquery."""
    return "(" + getattr(views, name)(views.DuckDialect()) + ")"
