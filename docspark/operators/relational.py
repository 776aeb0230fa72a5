"""Relational building blocks: keyset pages, newest-first feeds, idempotent writes, unions with deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must be total. Groups are cut before the shuffle (window group limit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def after_key(value: Column, row_id: Column, last_value: Column, last_id: Column) -> Column:
    """Whether a row comes after the cursor in descending order of (value nulls last, id)."""
    later = F.when(last_value.isNull(), value.isNull() & (row_id < last_id)).otherwise(value.isNull() | (value < last_value) | ((value == last_value) & (row_id < last_id)))
    return F.coalesce(later, F.lit(False))


def next_page(rows: DataFrame, cursors: DataFrame, group: str, value: str, row_id: str, limit: int) -> DataFrame:
    """The page behind each group's cursor ``(group, last_value, last_id)``; a group without a cursor has no page."""
    behind = rows.join(cursors, group).where(after_key(F.col(value), F.col(row_id), F.col("last_value"), F.col("last_id")))
    return top_per_group(behind.drop("last_value", "last_id"), [group], [F.col(value).desc_nulls_last(), F.col(row_id).desc()], limit)


def insert_new(incoming: DataFrame, stored: DataFrame, keys: list[str], within: bool = False) -> DataFrame:
    """Rows of ``incoming`` whose keys are not stored; ``within`` also drops repeats inside the batch. Null keys never match."""
    fresh = incoming.join(stored.select(*keys).distinct(), keys, "left_anti")
    return fresh.dropDuplicates(keys) if within else fresh


def first_of_union(parts: list[DataFrame], key: str, tie: list[str]) -> DataFrame:
    """Union of result lists, one row per non-null key: that of the earliest list. Rows with a null key all stay."""
    every = reduce(DataFrame.unionByName, [p.withColumn("list_no", F.lit(n)) for n, p in enumerate(parts)])
    known = top_per_group(every.where(F.col(key).isNotNull()), [key], [F.col("list_no"), *map(F.col, tie)], 1).drop("place")
    return known.unionByName(every.where(F.col(key).isNull()))


def strongest(rows: DataFrame, keys: list[str], status: str, ranks: dict[str, int]) -> DataFrame:
    """Monotone upsert: per key the status of highest rank; unknown statuses rank lowest."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(status)], F.lit(-1))
    return rows.groupBy(*keys).agg(F.max_by(status, F.struct(rank, F.col(status))).alias(status))


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Rows left in each child table ``name -> (rows, foreign key)`` once the ids in ``gone`` are removed."""
    return {name: rows.join(gone.select(F.col("id").alias(key)), key, "left_anti") for name, (rows, key) in tables.items()}


def words(text: Column) -> Column:
    """The distinct words of a text: lower case, split at all but ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def contains_all(searches: DataFrame, library: DataFrame) -> DataFrame:
    """``searches(id, user_id, text)``, ``library(user_id, paper_id, text)`` -> ``(id, paper_id)``.

    The papers of the user's own library whose text holds every word of the search, by one join on user and
    word. A search without words finds nothing. Ids of searches, and papers within a library, must be unique.
    """
    held = library.select("user_id", "paper_id", F.explode(words(F.col("text"))).alias("word"))
    return _all_held(_wanted(searches), held)


def contains_all_within(searches: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """As :func:`contains_all` over ``held(user_id, paper_id)``, whose papers have the words of all their ``texts(paper_id, text)``.

    Texts are cut into words before they meet the holders of their paper, and only words that are searched for go on: no
    text is repeated by holder, and the texts of a paper never are one.
    """
    wanted = _wanted(searches)
    cut = texts.select("paper_id", F.explode(words(F.col("text"))).alias("word"))
    known = cut.join(wanted.select("word").distinct(), "word", "left_semi").distinct()
    return _all_held(wanted, held.select("user_id", "paper_id").join(known, "paper_id"))


def _wanted(searches: DataFrame) -> DataFrame:
    return searches.select("id", "user_id", words(F.col("text")).alias("q")).select("id", "user_id", F.size("q").alias("n"), F.explode("q").alias("word"))


def _all_held(wanted: DataFrame, held: DataFrame) -> DataFrame:
    return wanted.join(held, ["user_id", "word"]).groupBy("id", "paper_id", "n").agg(F.count("*").alias("hits")).where("hits = n").select("id", "paper_id")
