"""Table loading: one parquet table per name in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
