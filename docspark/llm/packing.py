"""Filling containers of fixed capacity by swap-based local search.

Items are dealt to blocks by hash; a block is packed best-fit and then improved:
moves, one-for-one and two-for-one exchanges between underfull containers, each of which
makes a fuller container fuller still, so that the sum of squared fills grows and the emptiest
run empty. Containers still short of the wanted fill are opened again and their items
dealt to the blocks of the next round, so that little is lost at the blocks' borders.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.work import Work

#: Items of a block; rounds of opening what is below WANTED of the capacity.
BLOCK_ITEMS, ROUNDS, WANTED = 1000, 3, 0.998
#: Passes over the underfull containers of a block.
PASSES = 4


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by container, largest first, each into the fullest container that takes it."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            insort(room, (left - sizes[i], b))
    return bins


def _gains(fill: list[int], t: int, s: int, x: tuple, y: tuple, capacity: int) -> bool:
    """Whether items ``x`` and ``y`` for one of size ``s``, which goes where ``y`` was, fit and raise the sum of squared fills."""
    after = {b: fill[b] for b in (t, x[2], y[2])}
    before = sum(f * f for f in after.values())
    after[t] += x[0] + y[0] - s
    after[x[2]] -= x[0]
    after[y[2]] += s - y[0]
    return after[y[2]] <= capacity and sum(f * f for f in after.values()) > before


def improve(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search over the containers that are not full; every step raises the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for _ in range(PASSES):
        changed = False
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
        pool = sorted((sizes[i], i, b) for b in under for i in bins[b])
        for t in under:
            for x in [(sizes[i], i, t) for i in bins[t]]:  # donors are the containers less full than t
                pool.pop(bisect_left(pool, x))
            while pool and fill[t] < capacity:
                slack = capacity - fill[t]
                best = (0, None, ())
                k = bisect_right(pool, (slack, 1 << 60, 0)) - 1
                if k >= 0:
                    best = (pool[k][0], None, (k,))
                own = {sizes[i]: i for i in bins[t]}
                for s, i in own.items():
                    k = bisect_right(pool, (s + slack, 1 << 60, 0)) - 1
                    if k >= 0 and pool[k][0] - s > best[0]:
                        best = (pool[k][0] - s, i, (k,))
                if best[0] < slack:
                    for s, i in own.items():
                        limit, j, k = s + slack, 0, bisect_right(pool, (s + slack - pool[0][0], 1 << 60, 0)) - 1
                        while j < k:  # two pointers: the largest pair within the limit
                            both = pool[j][0] + pool[k][0]
                            if both > limit:
                                k -= 1
                                continue
                            if both - s > best[0] and _gains(fill, t, s, pool[j], pool[k], capacity):
                                best = (both - s, i, (j, k))
                                if both == limit:
                                    break
                            j += 1
                        if best[0] == slack:
                            break
                gain, out, taken = best
                if gain <= 0:
                    break
                given = [pool[k] for k in taken]
                for k in sorted(taken, reverse=True):
                    pool.pop(k)
                home = given[-1][2]
                if out is not None:
                    # what t gives goes where the larger item came from
                    bins[t].remove(out)
                    bins[home].append(out)
                    fill[home] += sizes[out]
                    insort(pool, (sizes[out], out, home))
                for s, i, b in given:
                    bins[b].remove(i)
                    fill[b] -= s
                    bins[t].append(i)
                fill[t] += gain
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def _pack(round_no: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        profile, block = key
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "part"], ignore_index=True)
        sizes = pdf["tokens"].astype(int).tolist()
        names: list = [None] * len(sizes)
        for n, b in enumerate(improve(sizes, best_fit(sizes, capacity), capacity)):
            if last or sum(sizes[i] for i in b) >= WANTED * capacity:
                for i in b:
                    names[i] = f"{round_no}-{block}-{n}"
        return pdf.assign(container=names)[["profile", "capacity", "container", "doc_id", "part", "tokens"]]

    return run


_PACKED = "profile string, capacity long, container string, doc_id bigint, part int, tokens bigint"


def pack(items: DataFrame, profiles: DataFrame, work: Work, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``items(doc_id, tokens)`` and ``profiles(profile, capacity_tokens)`` -> ``(profile, capacity, container, doc_id, part, tokens)``.

    Every item is whole in one container of each profile, unless it exceeds the capacity: then its
    full parts fill containers of their own and the rest (the last ``part``) is packed as an item. Items of no
    tokens or a null id take no place and are left out, as are profiles without a positive
    capacity. Repeated rows of an id count once (the largest size). Empty tables give an empty result.
    """
    one = items.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    some = profiles.where("profile is not null and capacity_tokens > 0").select("profile", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    both = one.join(F.broadcast(some), how="cross")  # each item once per profile; profiles are a fixed few
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    parts = both.withColumn("whole", whole).withColumn("rest", F.col("tokens") - F.col("whole") * F.col("capacity"))
    full = parts.where("whole > 0").select("profile", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"), F.col("capacity").alias("tokens"))
    full = full.select("profile", "capacity", F.format_string("full-%d-%d", "doc_id", "part").alias("container"), "doc_id", "part", "tokens")
    left = work.table(parts.where("rest > 0").select("profile", "capacity", "doc_id", F.col("whole").alias("part"), F.col("rest").alias("tokens")), "items")
    out = full
    for n in range(ROUNDS):
        counts = {r.profile: r["count"] for r in left.groupBy("profile").count().collect()}
        blocks = F.create_map(*[F.lit(x) for p, c in counts.items() for x in (p, max(1, round(c / block_items)))]) if counts else None
        if blocks is None:
            break
        last = n == ROUNDS - 1 or max(counts.values()) <= block_items
        dealt = left.withColumn("block", F.pmod(F.xxhash64(F.lit(n), "doc_id", "part"), blocks[F.col("profile")]).cast("int"))
        packed = work.table(dealt.groupBy("profile", "block").applyInPandas(_pack(n, last), _PACKED), "packed")
        out = out.unionByName(packed.where("container is not null"))
        left = packed.where("container is null").drop("container")
        if last:
            break
    return out


def fill_report(packed: DataFrame) -> DataFrame:
    """Per profile: containers, least possible number, tokens, and the share of the capacity used."""
    sums = packed.groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    report = sums.groupBy("profile", "capacity").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return report.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity")), 6))
