"""Where queries and their oracles are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL that says the same."""

    def add(f):
        QUERIES[f.__name__.lstrip("_")] = f
        if oracle is not None:
            ORACLES[f.__name__.lstrip("_")] = oracle
        return f

    return add
