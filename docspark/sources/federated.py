"""Result lists of several sources, each in its own format, as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sources(spark: SparkSession, sources: dict[str, tuple[str, str]], schema: str) -> DataFrame:
    """``sources(name -> (format, path))`` in the columns of ``schema``, with ``source`` and ``list_no`` (their order).

    Formats are those of ``spark.read``; a CSV source has a header. Columns a source lacks are null, others are left out and
    not read. No source gives an empty table.
    """
    wanted = spark.createDataFrame([], schema).schema
    parts = []
    for n, (name, (kind, path)) in enumerate(sources.items()):
        reader = spark.read.format(kind)
        if kind == "csv":
            have = spark.read.format(kind).option("header", True).load(path)
        else:
            have = reader.load(path)
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
        parts.append(have.select(*columns, F.lit(name).alias("source"), F.lit(n).alias("list_no")))
    empty = spark.createDataFrame([], wanted).select("*", F.lit("").alias("source"), F.lit(0).alias("list_no"))
    return reduce(DataFrame.unionByName, parts) if parts else empty
