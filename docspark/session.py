"""Session settings: one place for the options the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Options that hold for any deployment. Partition counts and memory belong to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "docspark", master: str | None = None, **options: str) -> SparkSession:
    """The session with :data:`DEFAULTS`; ``master`` only for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master.removeprefix("local[").removesuffix("]")
        builder = builder.master(master)
        if cores.isdigit():
            builder = builder.config("spark.sql.shuffle.partitions", cores)
        builder = builder.config("spark.driver.memory", os.environ.get("DOCSPARK_DRIVER_MEMORY", "8g"))
    for key, value in {**DEFAULTS, **options}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
