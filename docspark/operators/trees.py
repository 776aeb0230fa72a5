"""Structural and fuzzy clusters of a paper's chunks, and the summary nodes built from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.text import chunk_id, extractive_summary, normalize_title
from docspark.operators.components import connected_components
from docspark.operators.knn import QUERY_BLOCK, _pack, _usable, similar_pairs
from docspark.work import Work

LEAST_SIZE, MOST_SIZE = 3, 12
#: Rows of a paper whose memberships are worked out at once, fewer where a paper has many clusters; and pairs of a row and a cluster in one frame.
FUZZY_ROWS, FUZZY_PAIRS = 256, 1 << 16
#: Pairs of a row and a cluster of a paper above which a step is a job of several tasks (below, a job costs more than the step); rows of it that are packed together, and tasks at most.
LOCAL_PAIRS, FUZZY_PACK, FUZZY_TASKS = 64_000_000, 2048, 32
#: In such a step: rows and clusters of a tile, which stays in the cache, pairs held at once, and clusters whose sums are one row.
TILE, FUZZY_HELD, FUZZY_PART = (128, 512), 1 << 22, 2048


def structural_clusters(chunks: DataFrame) -> DataFrame:
    """``chunks(paper_id, chunk_id, section_hierarchy, section_title, first_order)`` -> ``(paper_id, chunk_id, cluster_no, n_in_cluster)``.

    Chunks are grouped by normalised top section in reading order; groups under 3 join a neighbour, groups over
    12 are cut by subsection, or in halves if they have none. Null sections count as 'unknown'; chunk ids must be unique.
    """
    top = F.coalesce(F.try_element_at("section_hierarchy", F.lit(1)), F.col("section_title"), F.lit("unknown"))
    sub = F.coalesce(normalize_title(F.try_element_at("section_hierarchy", F.lit(2))), F.lit("main"))
    rows = chunks.select("paper_id", "chunk_id", F.coalesce("first_order", F.lit(0)).alias("first_order"), F.coalesce(normalize_title(top), F.lit("unknown")).alias("section"), sub.alias("sub"))
    sections = rows.groupBy("paper_id", "section").agg(F.count("*").alias("n"), F.min("first_order").alias("first_order"))
    # the first sections wait for each other until they are a group; then small ones join the group before
    reading = Window.partitionBy("paper_id").orderBy("first_order", "section").rowsBetween(Window.unboundedPreceding, 0)
    held = sections.withColumn("held", F.sum("n").over(reading))
    opening = F.col("held") - F.col("n") < LEAST_SIZE
    groups = held.withColumn("opening", opening).withColumn("new", (~opening & (F.col("n") >= LEAST_SIZE)).cast("int")).select(
        "paper_id", "section", F.sum("new").over(reading).cast("int").alias("grp"), (~F.col("opening") & (F.col("new") == 0)).alias("appended")
    )
    placed = rows.join(groups, ["paper_id", "section"])
    sizes = placed.groupBy("paper_id", "grp").agg(F.count_if(~F.col("appended")).alias("n"), F.count_distinct(F.when(~F.col("appended"), F.col("sub"))).alias("n_subs"))
    placed = placed.join(sizes, ["paper_id", "grp"])
    order = Window.partitionBy("paper_id", "grp", "appended").orderBy("first_order", "chunk_id")
    by_sub = Window.partitionBy("paper_id", "grp", "appended", "sub")
    half = (F.row_number().over(order) > F.floor(F.col("n") / 2)).cast("int")
    part = F.when(F.col("n") <= MOST_SIZE, F.struct(F.lit(0).alias("a"), F.lit("").alias("b"))).when(F.col("n_subs") > 1, F.struct(F.min("first_order").over(by_sub).cast("int").alias("a"), F.col("sub").alias("b"))).otherwise(F.struct(half.alias("a"), F.lit("").alias("b")))
    # what is appended goes to the last part of its group
    placed = placed.withColumn("part", part)
    last = Window.partitionBy("paper_id", "grp")
    placed = placed.withColumn("part", F.when(F.col("appended"), F.max(F.when(~F.col("appended"), F.col("part"))).over(last)).otherwise(F.col("part")))
    number = F.dense_rank().over(Window.partitionBy("paper_id").orderBy("grp", "part")) - 1
    numbered = placed.select("paper_id", "chunk_id", number.alias("cluster_no"))
    return numbered.withColumn("n_in_cluster", F.count("*").over(Window.partitionBy("paper_id", "cluster_no")))


def centres(x: DataFrame, weight: str, dims: int) -> DataFrame:
    """Weighted means per paper and cluster of ``x(paper_id, cluster, vector)``: one sum per dimension, combined before the shuffle."""
    w = F.col(weight)
    sums = x.groupBy("paper_id", "cluster").agg(F.sum(w).alias("w"), *[F.sum(w * F.col("vector")[i]).alias(f"s{i}") for i in range(dims)])
    return sums.select("paper_id", "cluster", F.array(*[F.col(f"s{i}") / F.col("w") for i in range(dims)]).alias("centre"))


def _pulls(power: float, floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, c = (np.asarray(v, dtype=float).reshape(n, -1) for v, n in ((r.x_data, len(r.x_ids)), (r.centres, len(r.clusters))))
                n = len(c)
                # a paper may have more pairs of a chunk and a cluster than fit in memory
                few = max(1, FUZZY_PAIRS // 16 // n)
                some = -(-FUZZY_PAIRS // (few * n)) * few
                for at in range(0, len(x), some):
                    shares = []
                    for i in range(at, min(at + some, len(x)), few):
                        far = ((x[i : min(i + few, at + some), None, :] - c[None]) ** 2).sum(2)
                        pull = np.maximum(far, floor) ** -power
                        shares += list(pull / pull.sum(1, keepdims=True))
                    yield pd.DataFrame({"paper_id": r.grp, "chunk_id": r.x_ids[at : at + some], "clusters": [r.clusters] * len(shares), "us": shares})

    return run


def memberships(x: DataFrame, c: DataFrame, power: float = 2.0, floor: float = 1e-10) -> DataFrame:
    """``(paper_id, chunk_id, cluster, u)``: share of each cluster ``c(paper_id, cluster, centre)`` by inverse squared distance to the ``power``.

    A paper's rows are cut in blocks, each of which meets the matrix of the paper's centres, so that a hot paper is many tasks.
    """
    kind, whole = x.schema["chunk_id"].dataType.simpleString(), c.schema["cluster"].dataType.simpleString()
    rows = _usable(x.select(F.col("paper_id").alias("grp"), F.col("chunk_id").alias("id"), "vector"))
    sizes = rows.groupBy("grp", "dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    packed = _pack(rows, sizes, "x")
    matrix = c.groupBy(F.col("paper_id").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("m"))
    matrix = matrix.select("grp", F.col("m.cluster").alias("clusters"), F.flatten("m.centre").alias("centres"))
    dealt = sizes.join(matrix, "grp").withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = packed.drop("blocks").join(dealt, ["grp", "dim", "x_block"]).select("grp", "x_ids", "x_data", "clusters", "centres")
    shared = met.mapInPandas(_pulls(power, floor), f"paper_id string, chunk_id {kind}, clusters array<{whole}>, us array<double>")
    return shared.select("paper_id", "chunk_id", F.inline(F.arrays_zip(F.col("clusters").alias("cluster"), F.col("us").alias("u"))))


def _fuzzy(steps: int, tolerance: float, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        v = np.array(pdf["vector"].tolist(), dtype=float)
        good = np.isfinite(v).all(1)
        pdf, v = pdf[good].sort_values("chunk_id"), v[good][np.argsort(pdf["chunk_id"][good].to_numpy())]
        names = np.unique(pdf["cluster"].dropna().to_numpy())
        if not len(names):
            return pd.DataFrame(columns=["paper_id", "chunk_id", "cluster", "u"])
        n, d = v.shape
        v = v - v.mean(0)
        kept = min(50, max(2, n // 5), d, n - 1)
        if kept < d:
            v = v @ np.linalg.svd(v, full_matrices=False)[2][:kept].T
        square = (v * v).sum(1)
        # all memberships of a paper do not fit in memory: blocks of them are made from the centres when they are asked for
        rows = min(FUZZY_ROWS, max(16, (1 << 18) // len(names)))
        begun = np.where(pdf["cluster"].notna(), np.searchsorted(names, pdf["cluster"].fillna(names[0])), -1)

        def shares(i: int, c: np.ndarray | None) -> np.ndarray:
            if c is None:
                return (begun[i : i + rows, None] == np.arange(len(names))[None, :]).astype(float)
            far = np.maximum(square[i : i + rows, None] + (c * c).sum(1)[None, :] - 2 * v[i : i + rows] @ c.T, 1e-10)
            far *= far
            new = np.divide(1.0, far, out=far)
            new /= new.sum(1, keepdims=True)
            return new

        sums, placed = np.zeros((len(names), v.shape[1])), begun >= 0
        np.add.at(sums, begun[placed], v[placed])
        weights = np.bincount(begun[placed], minlength=len(names)).astype(float)
        c, last = None, 0
        for _ in range(steps):
            before, c = c, sums / np.maximum(weights, 1e-300)[:, None]
            sums, weights = 0.0, 0.0
            # whether any membership changed is settled by the first block that did, mostly the same one as a step before
            moved = float(np.abs(shares(last, c) - shares(last, before)).max()) >= tolerance
            for i in range(0, n, rows):
                new = shares(i, c)
                if not moved and float(np.abs(new - shares(i, before)).max()) >= tolerance:
                    moved, last = True, i
                new *= new
                sums = sums + new.T @ v[i : i + rows]
                weights = weights + new.sum(0)
            if not moved:
                break
        parts = []
        for i in range(0, n, rows):
            u = shares(i, c)
            row, k = np.nonzero(u >= threshold)
            parts.append((row + i, k, u[row, k]))
        row, k, u = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"paper_id": pdf["paper_id"].to_numpy()[row], "chunk_id": pdf["chunk_id"].to_numpy()[row], "cluster": names[k], "u": u})

    return run


class _Step:
    """Memberships of a pack of rows by the centres of a step, block by block; without centres, those of the start."""

    def __init__(self, c, k: int) -> None:
        self.c, self.k = c, k
        self.square = None if c is None else (c * c).sum(1)[None, :]

    def shares(self, v, begun):
        import numpy as np

        if self.c is None:
            return (begun[:, None] == np.arange(self.k)[None, :]).astype(float)
        far = np.maximum((v * v).sum(1)[:, None] + self.square - 2 * v @ self.c.T, 1e-10)
        far *= far
        new = np.divide(1.0, far, out=far)
        new /= new.sum(1, keepdims=True)
        return new


def _block_rows(k: int) -> int:
    return min(FUZZY_ROWS, max(16, (1 << 18) // k))


def _blocks_of(pdf: pd.DataFrame, dims: int, k: int):
    """``(pack, row, v, begun)`` of the blocks of packed rows."""
    import numpy as np

    rows = _block_rows(k)
    for r in pdf.itertuples(index=False):
        v, begun = np.frombuffer(r.v).reshape(-1, dims), np.frombuffer(r.begun, np.int32)
        for i in range(0, len(v), rows):
            yield r, i, v[i : i + rows], begun[i : i + rows]


class _Sums:
    """Weighted sums of rows, and the weights, of all clusters by the centres of a step.

    The pull of all clusters on some rows is made and held in tiles, since it takes the sum over a row before any of them counts.
    """

    def __init__(self, c, k: int, dims: int) -> None:
        import numpy as np

        self.sums, self.tiles = np.zeros((k, dims + 1)), []
        self.rows = min(TILE[0], max(16, FUZZY_HELD // k))
        if c is not None:
            # squared distances are one product: [v, 1, |v|^2] by [-2c, |c|^2, 1]
            right = np.c_[-2 * c, (c * c).sum(1), np.ones(k)].T
            some = [slice(j, min(k, j + TILE[1])) for j in range(0, k, TILE[1])]
            self.tiles = [(np.ascontiguousarray(right[:, t]), np.empty((self.rows, t.stop - t.start)), self.sums[t]) for t in some]

    def add(self, v, begun) -> None:
        import numpy as np

        one = np.ones((len(v), 1))
        if not self.tiles:
            np.add.at(self.sums, begun[begun >= 0], np.c_[v, one][begun >= 0])
            return
        left = np.c_[v, one, (v * v).sum(1)]
        for i in range(0, len(v), self.rows):
            x = left[i : i + self.rows]
            total = np.zeros(len(x))
            for right, held, _ in self.tiles:
                far = np.matmul(x, right, out=held[: len(x)])
                np.maximum(far, 1e-10, out=far)
                far *= far
                total += np.divide(1.0, far, out=far).sum(1)
            x = x[:, :-1] * total[:, None] ** -2
            for _, held, sums in self.tiles:
                pull = held[: len(x)]
                pull *= pull
                sums += pull.T @ x


def _fuzzy_by_jobs(rows: DataFrame, work: Work, dims: int, steps: int, tolerance: float, threshold: float, schema: str) -> DataFrame:
    """What :func:`_fuzzy` gives for the ``rows(paper_id, chunk_id, cluster, vector)`` of one paper, with a job a step. What tasks sum up is added by others: only the centres of a step reach the driver, once."""
    import numpy as np

    spark = rows.sparkSession
    sc = spark.sparkContext
    tasks = min(sc.defaultParallelism, FUZZY_TASKS)
    dealt = work.table(rows.select("paper_id", "chunk_id", "cluster", "vector").repartition(tasks, "chunk_id"), "hot")

    def usable(pdf: pd.DataFrame):
        v = np.array(pdf["vector"].tolist(), dtype=float).reshape(len(pdf), dims)
        good = np.isfinite(v).all(1)
        return pdf[good], v[good]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second, names = 0, np.zeros(dims), np.zeros((dims, dims)), set()
        for pdf in batches:
            pdf, v = usable(pdf)
            n, first, second = n + len(v), first + v.sum(0), second + v.T @ v
            names |= set(pdf["cluster"].dropna().astype(int))
        yield pd.DataFrame({"names": [sorted(names)], "data": [np.r_[n, first, second.ravel()].tobytes()]})

    got = dealt.mapInPandas(moments, "names array<long>, data binary").collect()
    names = np.array(sorted({k for r in got for k in r.names}))
    total = sum((np.frombuffer(r.data) for r in got), np.zeros(1))
    if not len(names):
        return spark.createDataFrame([], schema)
    n, k = int(total[0]), len(names)
    mean = total[1 : 1 + dims] / n
    kept = min(50, max(2, n // 5), dims, n - 1)
    values, axes = np.linalg.eigh(total[1 + dims :].reshape(dims, dims) - n * np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:kept]] if kept < dims else np.eye(dims)
    kept = axes.shape[1]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf, v = usable(pdf)
            v = (v - mean) @ axes
            cluster = pdf["cluster"].to_numpy(dtype=float, na_value=np.nan)
            begun = np.where(np.isnan(cluster), -1, np.searchsorted(names, np.where(np.isnan(cluster), names[0], cluster))).astype(np.int32)
            for i in range(0, len(v), FUZZY_PACK):
                ids = pdf["chunk_id"].iloc[i : i + FUZZY_PACK].tolist()
                yield pd.DataFrame({"paper_id": pdf["paper_id"].iloc[:1].tolist(), "ids": [ids], "v": [v[i : i + FUZZY_PACK].tobytes()], "begun": [begun[i : i + FUZZY_PACK].tobytes()]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packs = work.table(dealt.mapInPandas(packed, f"paper_id {kinds['paper_id']}, ids array<{kinds['chunk_id']}>, v binary, begun binary").withColumn("pack", F.monotonically_increasing_id()), "packs")

    value = lambda sent: None if sent is None else sent.value
    at_once = _block_rows(k)

    def summed(batches: Iterator[pd.DataFrame], now, then, at) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        c, moved = value(now), False
        out = _Sums(c, k, kept)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v, begun = np.frombuffer(r.v).reshape(-1, kept), np.frombuffer(r.begun, np.int32)
                if at and r.pack == at[0]:
                    some = slice(at[1], at[1] + at_once)
                    moved = float(np.abs(_Step(c, k).shares(v[some], begun[some]) - _Step(value(then), k).shares(v[some], begun[some])).max()) >= tolerance
                out.add(v, begun)
        for j in range(0, k, FUZZY_PART):
            yield pd.DataFrame({"part": [j], "task": [TaskContext.get().partitionId()], "moved": [moved], "data": [out.sums[j : j + FUZZY_PART].tobytes()]})

    def centred(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf.sort_values("task")["data"]).reshape(-1, kept + 1)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].tolist(), "moved": [bool(pdf["moved"].any())], "data": [(total[:, :kept] / np.maximum(total[:, kept:], 1e-300)).tobytes()]})

    def changed(batches: Iterator[pd.DataFrame], now, then) -> Iterator[pd.DataFrame]:
        new, old = _Step(value(now), k), _Step(value(then), k)
        for pdf in batches:
            for r, i, v, begun in _blocks_of(pdf, kept, k):
                if float(np.abs(new.shares(v, begun) - old.shares(v, begun)).max()) >= tolerance:
                    yield pd.DataFrame({"pack": [r.pack], "i": [i]})
                    return

    whole = packs.select("pack", "v", "begun")

    def step(now, then, at) -> tuple[bool, np.ndarray]:
        """Whether the block ``at`` changed, and the centres that follow."""
        sums = whole.mapInPandas(lambda batches: summed(batches, now, then, at), "part int, task int, moved boolean, data binary")
        got = sorted(work.collect(sums.groupBy("part").applyInPandas(centred, "part int, moved boolean, data binary")))
        return any(r.moved for r in got), np.concatenate([np.frombuffer(r.data).reshape(-1, kept) for r in got])

    now, then, at = None, None, None
    _, c = step(now, then, at)
    for n_steps in range(1, steps + 1):
        if then is not None:
            then.destroy()  # else the copies of all steps stay on the disk
        now, then = sc.broadcast(c), now
        if n_steps == steps:
            break
        moved, c = step(now, then, at)
        # the block that changed last is asked first; all blocks only where it did not
        if not moved:
            seen = whole.mapInPandas(lambda batches: changed(batches, now, then), "pack long, i int").collect()
            if not seen:
                break
            at = (seen[0].pack, seen[0].i)

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = _Step(value(now), k)
        for pdf in batches:
            for r, i, v, begun in _blocks_of(pdf, kept, k):
                u = last.shares(v, begun)
                row, j = np.nonzero(u >= threshold)
                if not len(row):  # a frame without rows has no single Arrow array of strings
                    continue
                yield pd.DataFrame({"paper_id": [r.paper_id] * len(row), "chunk_id": np.asarray(r.ids, dtype=object)[row + i], "cluster": names[j], "u": u[row, j]})

    return packs.mapInPandas(settled, schema)


def fuzzy_clusters(x: DataFrame, start: DataFrame, work: Work, dims: int, steps: int = 150, tolerance: float = 1e-4, threshold: float = 0.25, most: int = 2) -> DataFrame:
    """``x(paper_id, chunk_id, vector)``, ``start(paper_id, chunk_id, cluster)`` -> ``(paper_id, chunk_id, cluster, score)``.

    Fuzzy c-means of every paper on its min(50, max(2, n // 5), dims, n - 1) principal components, begun from the structural
    clusters, until no membership changes by ``tolerance`` or more, for ``steps`` steps at most; at most ``most`` clusters
    per chunk, of at least ``threshold``. The vectors of a paper meet in one task, those of a paper of many rows and clusters in
    several, step by step. A paper with fewer than two
    clusters gives nothing; vectors of other lengths and those with null or infinite entries are left out.
    """
    several = start.groupBy("paper_id").agg(F.count_distinct("cluster").alias("k")).where("k > 1").select("paper_id")
    points = work.table(x.where(F.size("vector") == dims).join(several, "paper_id", "left_semi").join(start, ["paper_id", "chunk_id"], "left"), "points")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("paper_id", "chunk_id", "cluster")) + ", u double"
    sizes = points.groupBy("paper_id").agg((F.count("*") * F.count_distinct("cluster")).alias("pairs")).where(F.col("pairs") > LOCAL_PAIRS)
    hot = [r.paper_id for r in sizes.collect()]  # papers of millions of pairs
    own = points.where(~F.col("paper_id").isin(hot)) if hot else points
    u = work.table(own.groupBy("paper_id").applyInPandas(_fuzzy(steps, tolerance, threshold), schema), "u")
    for p in hot:
        u = u.unionByName(work.table(_fuzzy_by_jobs(points.where(F.col("paper_id") == p), work, dims, steps, tolerance, threshold, schema), "u"))
    rank = F.row_number().over(Window.partitionBy("paper_id", "chunk_id").orderBy(F.desc("u"), "cluster"))
    return u.withColumn("rank", rank).where(F.col("rank") <= most).select("paper_id", "chunk_id", "cluster", F.round("u", 4).alias("score"))


def _resolved(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one group of resemblances: which node each is kept as, by going over the edges in id order."""
    nodes = nodes.sort_values("chunk_id", ignore_index=True)
    tokens = dict(zip(nodes["chunk_id"], nodes["token_count"].fillna(0)))
    into: dict[str, str] = {}
    for a, b in pairs.sort_values(["a", "b"])[["a", "b"]].itertuples(index=False):
        if a not in into and b not in into:
            longer = tokens[b] > tokens[a]
            into[a if longer else b] = b if longer else a

    def end(k: str) -> str:
        while k in into:
            k = into[k]
        return k

    kept = nodes["chunk_id"].map(end)
    links: dict[str, set] = {}
    for k, children in zip(kept, nodes["children"]):
        links.setdefault(k, set()).update(children if children is not None else ())
    return pd.DataFrame({"paper_id": nodes["paper_id"], "chunk_id": nodes["chunk_id"], "kept_as": kept, "n_children": [len(links[k]) for k in kept]})


def semantic_dedup(nodes: DataFrame, work: Work, threshold: float = 0.90) -> DataFrame:
    """``nodes(paper_id, chunk_id, vector, token_count, children)`` -> ``(paper_id, chunk_id, kept_as, n_children)``.

    In id order a node absorbs later ones at or above the threshold; the longer one stays (ties: the earlier) and takes
    over the links. Only nodes that resemble some other are resolved, per connected group of resemblances, from their pairs.
    """
    nodes = work.table(nodes, "nodes")
    pairs = work.table(similar_pairs(nodes.select(F.col("paper_id").alias("grp"), F.col("chunk_id").alias("id"), "vector"), threshold).select("a", "b"), "pairs")
    groups = work.table(connected_components(pairs, work), "groups")
    some = nodes.drop("vector").join(groups.select(F.col("node").alias("chunk_id"), "label"), "chunk_id")
    edges = pairs.join(groups.select(F.col("node").alias("a"), F.col("label").alias("pair_label")), "a")
    resolved = some.groupBy("label").cogroup(edges.groupBy("pair_label")).applyInPandas(_resolved, "paper_id string, chunk_id string, kept_as string, n_children long")
    alone = nodes.join(groups.select(F.col("node").alias("chunk_id")), "chunk_id", "left_anti")
    return resolved.unionByName(alone.select("paper_id", "chunk_id", F.col("chunk_id").alias("kept_as"), F.coalesce(F.size(F.array_distinct("children")), F.lit(0)).cast("bigint").alias("n_children")))


def group_evenly(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``group_no``: n rows in min(3, max(2, n // 3)) runs of equal size, the last one shorter."""
    n = F.count("*").over(Window.partitionBy(group))
    k = F.least(F.lit(3), F.greatest(F.lit(2), F.floor(n / 3)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("n_rows", n).withColumn("group_no", F.floor((place - 1) / F.ceil(n / k)))


def _built(members: DataFrame, level: int, start: str) -> DataFrame:
    """Nodes from ``members(paper_id, no, pos, id, text, first_page, last_page, first_order, last_order, key)``: ranges from the first member to the last, flags from the first, texts joined and summarised."""
    listed = members.groupBy("paper_id", "no").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text", "first_page", "last_page", "first_order", "last_order", "key"))).alias("m"))
    first, last = F.col("m")[0], F.element_at("m", -1)
    summary = F.array_join(F.transform("m", lambda x: extractive_summary(F.array(F.coalesce(x["text"], F.lit(""))))), " ")
    return listed.select(
        "paper_id",
        "no",
        chunk_id(F.col("paper_id"), F.lit(level), F.col(start)).alias("node_id"),
        F.lit(level).alias("level"),
        F.col("m.id").alias("children"),
        *[first[c].alias(c) for c in ("first_page", "first_order", "key")],
        *[last[c].alias(c) for c in ("last_page", "last_order")],
        summary.alias("text"),
    )


def tree_nodes(members: DataFrame, work: Work) -> DataFrame:
    """Summary nodes of every paper: ``(paper_id, node_id, level, parent_id, children, n_siblings, first_page, last_page, first_order, last_order, key, text)``.

    ``members(paper_id, cluster_id, pos, id, text, first_page, last_page, first_order, last_order, key)`` are the stored chunks of each
    structural cluster in reading order. Clusters of at least 3 become level 1; where a paper has two or more of those, they are grouped in
    even runs as level 2; the root takes level 2, or level 1 where there is none. Texts are extractive. Siblings are the other
    nodes of a level of the paper, given by their number: they are one list a paper, not one a node.
    """
    n = F.count("*").over(Window.partitionBy("paper_id", "cluster_id"))
    some = members.withColumn("n", n).where(F.col("n") >= LEAST_SIZE).withColumnRenamed("cluster_id", "no")
    one = work.table(_built(some, 1, "no"), "level1")
    as_members = lambda nodes: nodes.select("paper_id", F.col("no").alias("pos"), F.col("node_id").alias("id"), "text", "first_page", "last_page", "first_order", "last_order", "key")
    runs = group_evenly(as_members(one), "paper_id", ["pos"]).where("n_rows >= 2").withColumnRenamed("group_no", "no")
    two = work.table(_built(runs, 2, "no"), "level2")
    high = two.select("paper_id").distinct()
    last = as_members(two).unionByName(as_members(one.join(high, "paper_id", "left_anti"))).withColumn("no", F.lit(0))
    three = _built(last, 3, "no")
    every = work.table(one.unionByName(two).unionByName(three), "nodes")
    up = every.where("level > 1").select(F.col("node_id").alias("parent_id"), F.explode("children").alias("node_id"), "paper_id")
    count = every.groupBy("paper_id", "level").agg((F.count("*") - 1).alias("n_siblings"))
    return every.join(up, ["paper_id", "node_id"], "left").join(count, ["paper_id", "level"]).drop("no")
