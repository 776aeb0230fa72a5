"""Nearest neighbours of a stated query set against all rows, in blocks.

Rows and queries are packed into blocks of bounded size; every pair of a query
block and a row block is one matrix product in Arrow, which leaves only its own top k. No
pair of single rows ever exists as a row, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def _blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("vector")).alias(f"{name}_data"))


def _top(k: int, digits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def unit(flat, n: int) -> np.ndarray:
        x = np.asarray(flat, dtype=np.float64).reshape(n, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qi, qd, ri, rd in zip(pdf["q_ids"], pdf["q_data"], pdf["r_ids"], pdf["r_data"]):
                s = np.round(unit(qd, len(qi)) @ unit(rd, len(ri)).T, digits) + 0.0
                ri = np.asarray(ri)
                order = np.lexsort((np.broadcast_to(ri, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qi), order.shape[1]), "id": ri[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``queries(id, vector)`` against ``rows(id, vector)`` -> ``(query_id, id, score, rank)`` by cosine, ties by id.

    All vectors must have one length; null vectors are left out, an all-zero vector scores 0. Scores are rounded
    before ranking, so that ranks do not hang on the order of summation.
    """
    kind = rows.schema["id"].dataType.simpleString()
    some = [x.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")) for x in (queries, rows)]
    pairs = _blocks(some[0], "q", QUERY_BLOCK).join(_blocks(some[1], "r", ROW_BLOCK), how="cross")  # blocks, not rows
    best = pairs.select("q_ids", "q_data", "r_ids", "r_data").mapInPandas(_top(k, digits), f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _similar(threshold: float, digits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def unit(flat, n: int) -> np.ndarray:
        x = np.asarray(flat, dtype=np.float64).reshape(n, -1)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y, ai, ad, bi, bd in zip(*(pdf[c] for c in ("a_block", "b_block", "a_ids", "a_data", "b_ids", "b_data"))):
                s = np.round(unit(ad, len(ai)) @ unit(bd, len(bi)).T, digits) + 0.0
                ai, bi = np.asarray(ai), np.asarray(bi)
                p, q = np.nonzero(s >= threshold)
                a, b, v = ai[p], bi[q], s[p, q]
                if x == y:
                    keep = a < b
                    a, b, v = a[keep], b[keep], v[keep]
                swap = a > b
                yield pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "similarity": v})

    return run


def similar_pairs(rows: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """``rows(grp, id, vector)`` -> ``(a, b, similarity)``, a < b: pairs of one group at or above the cosine threshold.

    A group's rows are packed into blocks; a pair of blocks is one matrix product, so only pairs
    that qualify ever are rows, and a hot group is many tasks. Null groups, ids and vectors are left out, vectors of
    different lengths are not compared, all-zero vectors and vectors with nulls are similar to none. Ids must be unique.
    """
    kind = rows.schema["id"].dataType.simpleString()
    some = _usable(rows)
    sizes = some.groupBy("grp", "dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    packed = _pack(some, sizes, "a")
    # every pair of blocks is a key of its own
    low, high = F.least("a_block", "other"), F.greatest("a_block", "other")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = dealt.where("a_block <= other").select("grp", "dim", low.alias("i"), high.alias("j"), "a_block", "a_ids", "a_data")
    b = dealt.where("a_block >= other").select("grp", "dim", low.alias("i"), high.alias("j"), *[F.col(f"a_{c}").alias(f"b_{c}") for c in ("block", "ids", "data")])
    met = a.join(b, ["grp", "dim", "i", "j"]).drop("grp", "dim", "i", "j")
    return met.mapInPandas(_similar(threshold, digits), f"a {kind}, b {kind}, similarity double")


def _usable(rows: DataFrame, *others: str) -> DataFrame:
    known = rows.where("grp is not null and id is not null and vector is not null")
    return known.select("grp", F.size("vector").alias("dim"), "id", F.col("vector").cast("array<double>").alias("vector"), *others)


def _pack(rows: DataFrame, sizes: DataFrame, name: str, *others: str) -> DataFrame:
    """``rows`` in the blocks ``sizes(grp, dim, blocks)`` asks for, one row a block."""
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    lists = [F.collect_list(F.struct("id", "vector", *others)).alias("x")]
    packed = rows.join(sizes, ["grp", "dim"]).groupBy("grp", "dim", "blocks", block.alias(f"{name}_block")).agg(*lists)
    return packed.select("grp", "dim", "blocks", f"{name}_block", F.col("x.id").alias(f"{name}_ids"), F.flatten("x.vector").alias(f"{name}_data"), *[F.col(f"x.{c}").alias(f"{name}_{c}") for c in others])


def _top_allowed(digits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                u, v = (np.asarray(x, dtype=np.float64).reshape(n, -1) for x, n in ((r.q_data, len(r.q_ids)), (r.r_data, len(r.r_ids))))
                n = np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
                s = np.round(np.where(n == 0, 0.0, u @ v.T / np.where(n == 0, 1, n)), digits) + 0.0
                level, flags = np.asarray(r.r_level)[None, :], np.asarray(r.r_flags)[None, :]
                asked = np.asarray(r.q_flags)[:, None]
                ok = (level >= np.asarray(r.q_least_level)[:, None]) & (level <= np.asarray(r.q_most_level)[:, None]) & (asked & ~flags == 0) & (s >= 0)
                ids = np.asarray(r.r_ids)
                s = np.where(ok, s, -1.0)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, : int(max(r.q_top_k))]
                some = np.take_along_axis(ok, order, 1) & (np.arange(order.shape[1])[None, :] < np.asarray(r.q_top_k)[:, None])
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(r.q_ids), some.sum(1)), "chunk_id": ids[order[some]], "score": np.take_along_axis(s, order, 1)[some], "top_k": np.repeat(np.asarray(r.q_top_k), some.sum(1))})

    return run


def top_within(queries: DataFrame, rows: DataFrame, digits: int = 6) -> DataFrame:
    """``queries(grp, id, vector, least_level, most_level, flags, top_k)`` against the ``rows(grp, id, vector, level, flags)`` of their group.

    Gives ``(query_id, chunk_id, score, top_k)``, of every block of rows at most ``top_k`` per query: cosine not below 0, rows of a level in range
    that have all flags (bits) asked for. Groups are cut in blocks of rows and of queries, and each pair of blocks is one matrix product and a key of its
    own, so a hot group is many tasks. Null groups, ids and vectors are left out, as are vectors of another length than the
    query's and those with nulls; an all-zero vector scores 0.
    """
    kind = rows.schema["id"].dataType.simpleString()
    q, r = _usable(queries, "least_level", "most_level", "flags", "top_k"), _usable(rows, "level", "flags")
    n = q.select("grp", "dim", F.lit(1).alias("q"), F.lit(0).alias("r")).union(r.select("grp", "dim", F.lit(0), F.lit(1))).groupBy("grp", "dim").agg(F.sum("q").alias("q"), F.sum("r").alias("r"))
    sizes = n.where("q > 0 and r > 0").select("grp", "dim", F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("q_blocks"), F.ceil(F.col("r") / ROW_BLOCK).cast("int").alias("r_blocks"))

    def packed(some: DataFrame, own: str, other: str, *columns: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        lists = some.join(sizes, ["grp", "dim"]).groupBy("grp", "dim", f"{other}_blocks", block).agg(F.collect_list(F.struct("id", "vector", *columns)).alias("x"))
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return lists.select("grp", "dim", f"{own}_block", every, F.col("x.id").alias(f"{own}_ids"), F.flatten("x.vector").alias(f"{own}_data"), *[F.col(f"x.{c}").alias(f"{own}_{c}") for c in columns])

    met = packed(q, "q", "r", "least_level", "most_level", "flags", "top_k").join(packed(r, "r", "q", "level", "flags"), ["grp", "dim", "q_block", "r_block"])
    return met.drop("grp", "dim", "q_block", "r_block").mapInPandas(_top_allowed(digits), f"query_id {kind}, chunk_id {kind}, score double, top_k int")
