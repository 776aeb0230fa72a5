"""Intermediate tables in the folder all executors share.

Lineage is cut by writing a table and reading it again, so that a lost executor
costs a re-read and not a recomputation. The folder is the session's
``spark.checkpoint.dir``; a folder of our own is set only on a local master
where none is named.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

#: Whether shuffle files are removed when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises where a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Work:
    """Names, writes and removes the intermediate tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/docspark/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    @contextmanager
    def _cleanup(self) -> Iterator[None]:
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)

    def collect(self, df: DataFrame) -> list[Row]:
        """The few rows of ``df``; its shuffle files go with its end."""
        with self._cleanup():
            return df.collect()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table; the shuffle files of the write go with its end, not with some later garbage collection."""
        at = self.path(name)
        with self._cleanup():
            df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._docspark_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table made by :meth:`table`; nothing may read it afterwards."""
        at = getattr(df, "_docspark_path", None)
        if at:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
