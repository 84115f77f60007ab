"""Registry of the queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; one without ``sql`` is tested against a brute-force version."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL by name, in the order of their numbers."""
    from zephra import llm

    for mod in pkgutil.iter_modules(llm.__path__):
        importlib.import_module(f"zephra.llm.{mod.name}")
    order = sorted(QUERIES, key=lambda n: int(n.removeprefix("op").split("_")[0]))
    return {n: QUERIES[n] for n in order}, dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
