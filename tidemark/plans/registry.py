"""All registered queries, by name, with the DuckDB SQL of each."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def widened(df: DataFrame) -> DataFrame:
    """Integers as long and floats as double, so that results have one schema whichever function counted."""
    wide = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(wide[t]).alias(c) if t in wide else F.col(f"`{c}`") for c, t in df.dtypes]) if any(t in wide for _, t in df.dtypes) else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql gives the same rows in DuckDB."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: widened(f(spark, sf_dir))
        if sql:
            _ORACLES[name] = sql
        return f

    return put


MODULES = ("retrieval", "statistics", "projections", "joins", "aggregates", "ordering", "text", "datasets", "search", "geometry", "io")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank fusion of three keyword runs, scored against the planted passages."""
    return queries()["mt9_hit_mrr"](spark, sf_dir)
