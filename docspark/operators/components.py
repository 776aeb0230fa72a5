"""Connected components of an edge table, without collecting edges or labels.

Edges are contracted inside each partition first (union-find over one Arrow
partition; what leaves it is a star forest), then large-star and small-star
rounds run on the rest until the stars no longer change. Every round is two
shuffles of the edges left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.work import Work


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the edges of a partition by stars around each local component's smallest node."""
    up: dict = {}

    def find(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(find(x), x) for x in list(up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for k in range(0, len(pairs), 50_000):
        yield pd.DataFrame(pairs[k : k + 50_000], columns=["a", "b"])


def connected_components(edges: DataFrame, work: Work, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of one comparable type -> ``(node, label)``, the label being the smallest node.

    Nulls, loops and repeated edges are ignored; a node without an edge does not
    come out. An empty edge table gives an empty result. Raises if the stars still
    change after ``max_rounds`` rounds (2**max_rounds nodes in a path).
    """
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    clean = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = work.table(clean.mapInPandas(_contract, schema), "cc")
    before = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m"), F.col("u"))).distinct()
        after = work.table(small, "cc")
        n, stamp = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(now)
        now = after
        if n == 0 or (n, stamp) == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select("a", "a").distinct())
        before = (n, stamp)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) of ``n`` items under the edges ``a[i]-b[i]``, by vectorised hooking and doubling."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label
