"""A chunk store on parquet, partitioned by paper and level.

Filters on paper and level prune partitions. Rows are appended only when
their content is new to the paper; papers and levels are removed by dropping their
partitions; link updates rewrite the partitions they touch and no others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docspark.operators.relational import insert_new
from docspark.work import Work

LINKS = ("parent_ids", "children_ids", "sibling_ids", "cluster_ids", "cluster_probabilities")


class ChunkStore:
    """``schema`` is that of the rows, ``paper_id`` and ``level`` included."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        """All rows; an empty table before the first write."""
        if not self._fs.exists(self._path(self.path)):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def scan(self, paper_id: str | None = None, levels: Iterable[int] | None = None) -> DataFrame:
        """Rows of a paper and of some levels; both filters prune partitions."""
        df = self.read()
        if paper_id is not None:
            df = df.where(F.col("paper_id") == paper_id)
        return df if levels is None else df.where(F.col("level").isin(*levels))

    def _write(self, df: DataFrame, mode: str, seen: Observation | None = None) -> None:
        # opening a file costs more than its rows: those of a partition meet in one task, which writes one file; a count given outright keeps the tasks apart
        df = df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "paper_id", "level")
        df = df.observe(seen, F.count(F.lit(1)).alias("n")) if seen else df
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("paper_id", "level").parquet(self.path)

    def upsert(self, rows: DataFrame, within: bool = False) -> int:
        """Appends rows whose content hash the paper does not have yet; returns how many. ``within`` drops repeats inside the batch too."""
        seen = Observation()
        fresh = insert_new(rows, self.read().select("paper_id", "content_hash"), ["paper_id", "content_hash"], within)
        self._write(fresh.select(*[f.name for f in self.read().schema]), "append", seen)
        return int(seen.get["n"] or 0)

    def _drop(self, match) -> int:
        """Removes the partition folders for which ``match(paper folder, level folder)`` holds."""
        n = 0
        if not self._fs.exists(self._path(self.path)):
            return n
        for status in self._fs.globStatus(self._path(f"{self.path}/paper_id=*/level=*")):
            at = status.getPath()
            if match(at.getParent().getName().removeprefix("paper_id="), at.getName().removeprefix("level=")):
                n += bool(self._fs.delete(at, True))
        return n

    def delete_papers(self, paper_ids: Iterable[str]) -> int:
        """Drops the papers' partitions; returns how many."""
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        gone = {escape(p) for p in paper_ids}
        return self._drop(lambda paper, level: paper in gone)

    def delete_levels(self, least: int, most: int = 1 << 30) -> int:
        """Drops a range of levels of every paper; returns how many partitions."""
        return self._drop(lambda paper, level: level.lstrip("-").isdigit() and least <= int(level) <= most)

    def update_links(self, updates: DataFrame) -> None:
        """Sets the link fields of ``updates(chunk_id, ...)`` that are not null; ids that are not stored are ignored.

        Only partitions that hold an updated chunk are rewritten, from a written copy.
        """
        work = Work(self.spark, "links")
        stored = self.read()
        fields = [c for c in LINKS if c in updates.columns and c in stored.columns]
        new = updates.groupBy("chunk_id").agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in fields])
        touched = stored.join(new.select("chunk_id"), "chunk_id", "left_semi").select("paper_id", "level").distinct()
        some = stored.join(touched, ["paper_id", "level"], "left_semi").join(new, "chunk_id", "left")
        merged = some.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns])
        self._write(work.table(merged, "merged"), "overwrite")


def dump_json(df: DataFrame, path: str) -> None:
    """Writes rows as JSON lines, for a look at chunks, references or tree graphs."""
    df.write.mode("overwrite").json(path)
