"""Mixing sources to target weights by hash-random order and distributed prefix sums.

The total is the largest one at which no source must be repeated beyond its cap.
A source's budget takes whole epochs of all its documents, then a cut of one more: documents
get a hash-random key, are range-sorted by source and key, each range partition's tokens
are summed per source, and a running sum over partitions and inside them is cut at the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.work import Work


def mix(sizes: DataFrame, targets: DataFrame, work: Work, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``sizes(doc_id, source, tokens)`` and ``targets(source, target_share, max_repeats)`` -> ``(chosen, report)``.

    ``chosen(source, doc_id, tokens, repeats)``: each document used and how often. ``report(source, target_share,
    max_repeats, n_documents, n_chosen, available_tokens, used_tokens, actual_share)``: one row per target.
    A target without documents (or tokens) gets nothing and the others keep their proportions; documents of null or
    unlisted sources and of no tokens are left out; a target of no share or no repeats gets nothing. Repeated rows
    of an id count once. ``total`` beyond what the caps allow is lowered to that.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = sizes.where("doc_id is not null and source is not null and tokens > 0").groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"))
    listed = docs.join(wanted.select("source"), "source")
    keyed = listed.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    ordered = keyed.repartitionByRange(F.col("source"), F.col("key"), F.col("doc_id")).withColumn("range", F.spark_partition_id())
    ordered = work.table(ordered, "ordered")

    # one row per source and range partition; the hot source is spread over many
    sums = ordered.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    stock = wanted.join(sums.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("n").alias("n_documents")), "source", "left")
    plan = stock.collect()  # as many rows as there are targets
    usable = {r.source: r for r in plan if r.available and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    whole = sum(r.target_share for r in usable.values())
    most = min((r.max_repeats * r.available * whole / r.target_share for r in usable.values()), default=0)
    size = most if total is None else min(total, most)
    budgets = [(s, int(size * r.target_share / whole), int(r.available)) for s, r in usable.items()]
    cuts = [(s, b // a, b - b // a * a) for s, b, a in budgets]
    limits = F.broadcast(work.spark.createDataFrame(cuts, "source string, epochs long, cut long"))

    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    running = ordered.withColumn("sum", F.sum("tokens").over(inside)).join(offsets.select("source", "range", "before"), ["source", "range"])
    counted = running.join(limits, "source").withColumn("repeats", F.col("epochs") + ((F.col("before") + F.col("sum")) <= F.col("cut")).cast("long"))
    chosen = work.table(counted.where("repeats > 0").select("source", "doc_id", "tokens", "repeats"), "chosen")

    used = chosen.groupBy("source").agg(F.count("*").alias("n_chosen"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    zero = F.lit(0).cast("long")
    report = stock.join(used, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        *[F.coalesce(a, zero).alias(b) for a, b in (("n_documents", "n_documents"), ("n_chosen", "n_chosen"), ("available", "available_tokens"), ("used_tokens", "used_tokens"))],
    )
    every = report.agg(F.sum("used_tokens").alias("all_tokens"))
    report = report.join(F.broadcast(every), how="cross")  # a single row
    share = F.when(F.col("all_tokens") > 0, F.round(F.col("used_tokens") / F.col("all_tokens"), 6)).otherwise(F.lit(0.0))
    return chosen, report.withColumn("actual_share", share).drop("all_tokens")
