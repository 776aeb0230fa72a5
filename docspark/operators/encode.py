"""The default encoders: dense and sparse columns of texts where no model is plugged in.

The dense vector is that of hashed term counts at unit length; the sparse one holds TF-IDF weights of the first
512 terms under hashed indices. Both come from one table of term counts, so a text's terms are shuffled once, combined per text before
they travel. A model is a function ``texts -> vectors`` in the place of either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import vectors
from docspark.work import Work

#: Entries of the dense vector, terms of a text that count for the sparse one, and sparse indices there are.
DIMS, MOST_TERMS, SLOTS = 64, 512, 30_000


def _hash(width: int):
    return F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % width


def embed(rows: DataFrame, work: Work) -> DataFrame:
    """``rows(id, text)`` -> ``(id, dense, sparse_indices, sparse_values)``; indices ascend.

    Null and empty texts, and texts without a term, have null columns. Ids must be unique and not null.
    """
    ids = rows.select("id", "text")
    words = ids.select("id", F.posexplode(vectors.terms(F.col("text"))).alias("pos", "term"))
    counts = work.table(words.groupBy("id", "term").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("pos") < MOST_TERMS).alias("tf")), "terms")
    slots = counts.groupBy("id", _hash(DIMS).alias("slot")).agg(F.sum("n").alias("n"))
    filled = slots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("bigint")), F.lit(0.0)))
    dense = filled.select("id", vectors.normalize(whole).alias("dense"))
    held = counts.where("tf > 0")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    total = ids.agg(F.count("*").alias("total"))  # one row
    weight = F.log1p("tf") * F.log((F.col("total") + 1) / (F.col("df") + 1))
    weighed = held.join(df, "term").join(F.broadcast(total), how="cross").groupBy("id", _hash(SLOTS).cast("int").alias("i")).agg(F.sum(weight).alias("w")).where("w > 0")
    pairs = weighed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("x"))
    sparse = pairs.select("id", F.col("x.i").alias("sparse_indices"), F.col("x.w").alias("sparse_values"))
    return ids.select("id").join(dense, "id", "left").join(sparse, "id", "left")
