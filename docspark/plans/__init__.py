"""Query plans by area; every module has QUERIES and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, the type SQL's counts and sums have."""
    return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, t in df.dtypes])


def registry(queries: dict, sql: dict[str, str]) -> Callable:
    """A decorator that adds a query, and its SQL if given, under the function's name."""

    def query(text: str | None = None):
        def add(f):
            @wraps(f)
            def run(spark, directory):
                return _wide(f(spark, directory))

            queries[f.__name__] = run
            if text:
                sql[f.__name__] = text
            return run

        return add

    return query
