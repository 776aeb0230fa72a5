"""Pairs inside groups where the pairs themselves are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that are one block when its pairs are listed.
BLOCK_ROWS = 2_000


def pairs_within(members: DataFrame, group: str, name: str, *others: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``members(group, n, name, others...)`` -> ``(name_a, name_b, others_a, others_b)``, name_a < name_b.

    ``n`` is the group's number of rows. A hot group is dealt over pairs of blocks, so that it is many
    tasks and no key of the join holds more than a few thousand rows. Rows with a null group or name have no pairs.
    """
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64(name), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    a = dealt.select(group, F.col("_own").alias("_i"), other.alias("_j"), *[F.col(c).alias(f"{c}_a") for c in (name, *others)])
    b = dealt.select(group, other.alias("_i"), F.col("_own").alias("_j"), *[F.col(c).alias(f"{c}_b") for c in (name, *others)])
    return a.join(b, [group, "_i", "_j"]).where(F.col(f"{name}_a") < F.col(f"{name}_b")).drop(group, "_i", "_j")
