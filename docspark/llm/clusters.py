"""Similarity clusters of vectors by Gaussian mixtures.

Unit vectors are standardised and reduced (principal components of all rows). A
mixture with regularised diagonal covariance is fitted by expectation-maximisation
over all rows until the likelihood settles, one job per step, several numbers of components at once; the Bayesian
information criterion chooses. Components that are still large are split the same way, level by
level, over their own rows alone, which lie together by then; so a task sums for the components it has rows of. The
mixture is then both the clustering and its index. Inside a leaf members are
checked against the likeness itself, in blocks; fragments of all leaves are then compared with each
other, a pair being passed over only where the triangle inequality on angles proves that no two of its
members are alike, so that a cluster that straddles leaves is put together again whatever the leaves.
The members of highest density under their component represent a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.operators.components import connected_components, local_components
from docspark.work import Work

LIKENESS = 0.8
#: Dimensions kept, rows a leaf should have, rows compared at once.
DIMS, LEAF_ROWS, BLOCK_ROWS = 16, 1500, 2048
#: Numbers of components tried for the whole and for a component that is split further.
FIRST, FURTHER = (8, 16, 32), (1, 2, 4, 8, 16)
#: Steps end when no mixture gains this much log-likelihood a row, at the latest after so many; levels there may be.
GAIN, MOST_STEPS, MAX_LEVELS = 0.05, 40, 8
#: A component of at most so many rows is fitted in one task, step by step; a larger one by a job a step.
LOCAL_ROWS = 16_000
#: Added to every variance (features are standardised), so that no component collapses.
RIDGE = 1e-2
#: Rows of each component from which initial means are drawn, expected; the fit itself takes all rows.
SEED_ROWS = 1_000
#: Rows of a pack of fragments, pairs of packs handed to Python at once, and rows of near fragments compared at once.
PACK_ROWS, PACK_PAIRS, NEAR_ROWS = 16_384, 1, 1 << 16
#: First sums of a mixture's shares; a second one adds them up.
SUM_PARTS = 32
#: Radians allowed for rounding in the bounds on angles, and the sum of angles from which on fragments are always near.
SLACK, WIDE = 2e-3, 3.0


def _units(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector, and their unit vectors."""
    column = batch.column("vector")
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = np.cumsum(lengths)
    rows = np.flatnonzero(lengths == dim)
    x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    # scaled by the largest entry first: squares of tiny or huge entries do not under- or overflow
    top = np.abs(x).max(axis=1, initial=0.0)
    good = np.isfinite(top) & (top > 0)
    x = x[good] / top[good][:, None]
    return rows[good], x / np.linalg.norm(x, axis=1)[:, None]


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(raw, np.float64) for raw in pdf["data"])
    return pd.DataFrame({"one": [0], "data": [total.tobytes()]})


def _total(parts: DataFrame) -> np.ndarray | None:
    """The sum of the arrays in ``data`` over all partitions, in two steps; one array reaches the driver."""
    some = parts.withColumn("k", F.spark_partition_id() % SUM_PARTS).groupBy("k").applyInPandas(_sum_rows, "one int, data binary")
    whole = some.groupBy("one").applyInPandas(_sum_rows, "one int, data binary").collect()
    return np.frombuffer(whole[0].data, np.float64) if whole else None


def _moments(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            _, u = _units(b, dim)
            n, first, second = n + len(u), first + u.sum(0), second + u.T @ u
        if n:
            yield pa.RecordBatch.from_pydict({"data": [np.r_[n, first, second.ravel()].tobytes()]})

    return run


def _features(dim: int, mean: np.ndarray, to: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, u = _units(b, dim)
            z = ((u - mean) @ to).astype(np.float32)
            u = u.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows)), pa.array([r.tobytes() for r in u], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], names=["id", "u", "z"]
            )

    return run


class Mixture:
    """One level: components with their parent, weight, mean and variance; those of a parent stand together."""

    def __init__(self, parent: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray, rows: np.ndarray | None = None, steps: int = 0) -> None:
        self.parent, self.weight, self.mean, self.var, self.rows, self.steps = parent, weight, mean, var, rows, steps
        start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        self.of = {int(parent[i]): np.arange(i, j) for i, j in zip(start, np.r_[start[1:], len(parent)])}

    def log_density(self, z: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Weighted log densities of rows ``z`` under the components ``some``."""
        inv = 1 / self.var[some]
        mean = self.mean[some]
        const = np.log(np.maximum(self.weight[some], 1e-300)) - 0.5 * (np.log(2 * np.pi * self.var[some]).sum(1) + (mean * mean * inv).sum(1))
        return const - 0.5 * (z * z) @ inv.T + z @ (mean * inv).T


def _by(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``at`` with the rows that have it."""
    order = np.argsort(at, kind="stable")
    start = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else np.zeros(0, int)
    for i, j in zip(start, np.r_[start[1:], len(at)]):
        yield int(at[order[i]]), order[i:j]


def route(levels: list[Mixture], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's leaf ``(level, component)`` as one number, and its log density there."""
    leaf, density = np.full(len(z), -1), np.zeros(len(z))
    at = np.full(len(z), -1)
    live = np.arange(len(z))
    for depth, m in enumerate(levels):
        nxt = []
        for p, some in _by(at[live]):
            kids = m.of.get(p)
            if kids is None:
                continue
            rows = live[some]
            d = m.log_density(z[rows], kids)
            best = d.argmax(1)
            at[rows], density[rows] = kids[best], d[np.arange(len(rows)), best]
            leaf[rows] = (depth << 32) + kids[best]
            nxt.append(rows)
        if not nxt:
            break
        live = np.concatenate(nxt)
    return leaf, density


def _floats(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a column of packed 32-bit numbers without nulls, as they lie in its buffer."""
    if not len(column):
        return np.zeros((0, d))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, d).astype(np.float64)


def _rows_of(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(b.column("parent")), _floats(b.column("z"), d)


def _expect(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The statistics of one step of those mixtures (a parent's trials) that have rows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = sent.value, {}
        d = next(iter(of.values()))[0][1].mean.shape[1]
        for b in batches:
            parent, z = _rows_of(b, d)
            for p, rows in _by(parent):
                for g, m in of.get(p, ()):
                    own = _statistics(m, np.arange(len(m.mean)), z[rows])
                    held[g] = held[g] + own if g in held else own
        if held:
            # shares are added in two steps, by the square root of their number or so
            part = TaskContext.get().partitionId() % SUM_PARTS
            yield pa.RecordBatch.from_pydict({"g": pa.array(list(held), pa.int32()), "part": pa.array([part] * len(held), pa.int32()), "data": [x.tobytes() for x in held.values()]})

    return run


def _sum_group(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"g": [pdf["g"].iloc[0]], "data": [sum(np.frombuffer(raw, np.float64) for raw in pdf["data"]).tobytes()]})


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding."""
    picked = [x[rng.integers(len(x))]]
    far = ((x - picked[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = far.sum()
        nxt = x[rng.choice(len(x), p=far / total)] if total > 0 else x[rng.integers(len(x))]
        picked.append(nxt)
        far = np.minimum(far, ((x - nxt) ** 2).sum(1))
    return np.array(picked)


def _drawn(sizes: tuple[int, ...]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Initial means of every number of components from the rows drawn of one parent, and those rows' variance."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(pdf["z"])), np.float32).reshape(len(pdf), -1).astype(np.float64)
        rng = np.random.default_rng(7)
        return pd.DataFrame({"parent": [key[0]] * len(sizes), "k": list(sizes), "means": [_seeds(x, k, rng).tobytes() for k in sizes], "var": [x.var(0).tobytes()] * len(sizes)})

    return run


def _statistics(model: Mixture, some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row counts, sums and squares of the components ``some``, and the log likelihood of the rows ``x``."""
    logp = model.log_density(x, some)
    top = logp.max(1, keepdims=True)
    r = np.exp(logp - top)
    s = r.sum(1, keepdims=True)
    r /= s
    return np.concatenate([r.sum(0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel(), [float((top + np.log(s)).sum())]])


def _maximised(model: Mixture, some: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows, weights, means and variances of the components ``some`` after a step, and the log likelihood before it."""
    k, d = len(some), model.mean.shape[1]
    n, seen = np.maximum(sums[:k], 1e-9)[:, None], sums[:k, None] > 1e-6
    mean = np.where(seen, sums[k : k + k * d].reshape(k, d) / n, model.mean[some])
    var = np.where(seen, np.maximum(sums[k + k * d : k + 2 * k * d].reshape(k, d) / n - mean * mean, 0) + RIDGE, model.var[some])
    return sums[:k], sums[:k] / max(sums[:k].sum(), 1e-9), mean, var, float(sums[-1])


def _bic(k: int, d: int, rows: float, likelihood: float) -> float:
    return (k * (2 * d + 1) - 1) * np.log(max(rows, 2)) - 2 * likelihood


def _start(parent: int, k: int, means: np.ndarray, var: np.ndarray) -> Mixture:
    return Mixture(np.full(k, parent), np.full(k, 1 / k), means, np.tile((var + RIDGE) / (1 if k == 1 else 2), (k, 1)))


_FITTED = "parent long, weight double, mean binary, var binary, rows double, steps int"


def _fitted(m: Mixture) -> pd.DataFrame:
    """The components of a mixture that hold rows."""
    used = np.flatnonzero(m.rows >= 0.5)
    used = used if len(used) else np.arange(1)
    return pd.DataFrame({"parent": m.parent[used], "weight": m.weight[used], "mean": [x.tobytes() for x in m.mean[used]], "var": [x.tobytes() for x in m.var[used]], "rows": m.rows[used], "steps": m.steps})


def _local(sizes: tuple[int, ...]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The mixture of one component's rows of least BIC."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(sorted(pdf["z"])), np.float32).reshape(len(pdf), -1).astype(np.float64)
        seeds = np.frombuffer(b"".join(sorted(pdf["z"][pdf["drawn"]]) or sorted(pdf["z"])), np.float32).reshape(-1, x.shape[1]).astype(np.float64)
        rng, best = np.random.default_rng(7), None
        for k in sizes:
            m, before = _start(key[0], k, _seeds(seeds, k, rng), seeds.var(0)), -np.inf
            for step in range(1, MOST_STEPS + 1):
                rows, weight, mean, var, likelihood = _maximised(m, np.arange(k), _statistics(m, np.arange(k), x))
                m = Mixture(m.parent, weight, mean, var, rows, step)
                gain, before = (likelihood - before) / len(x), likelihood
                if gain <= GAIN:
                    break
            score = _bic(k, x.shape[1], len(x), before)
            if best is None or score < best[0]:
                best = (score, m)
        return _fitted(best[1])

    return run


def _by_jobs(live: DataFrame, drawn: DataFrame, parents: dict[int, float], sizes: tuple[int, ...]) -> list[Mixture]:
    """The same for components of any size: one job a step for all their mixtures that still gain."""
    spark = live.sparkSession
    drawn = drawn.groupBy("parent").applyInPandas(_drawn(sizes), "parent long, k int, means binary, var binary").collect()
    trials = [_start(r.parent, r.k, np.frombuffer(r.means, np.float64).reshape(r.k, -1), np.frombuffer(r.var, np.float64)) for r in sorted(drawn, key=lambda r: (r.parent, r.k))]
    shares = live.rdd.getNumPartitions()
    likelihood, open_ = [-np.inf] * len(trials), set(range(len(trials)))
    for step in range(1, MOST_STEPS + 1):
        of: dict[int, list] = {}
        for g in open_:
            of.setdefault(int(trials[g].parent[0]), []).append((g, trials[g]))
        sent = spark.sparkContext.broadcast(of)  # the model: as many rows as components on trial
        sums = live.select("parent", "z").mapInArrow(_expect(sent), "g int, part int, data binary")
        if shares > SUM_PARTS:
            sums = sums.groupBy("g", "part").applyInPandas(_sum_group, "g int, data binary")
        if len(trials) > SUM_PARTS:  # few mixtures: their shares, at most SUM_PARTS each, are added here
            sums = sums.groupBy("g").applyInPandas(_sum_group, "g int, data binary")
        total: dict[int, np.ndarray] = {}
        for r in sums.collect():
            x = np.frombuffer(r.data, np.float64)
            total[r.g] = total[r.g] + x if r.g in total else x
        for g, x in total.items():
            m = trials[g]
            rows, weight, mean, var, now = _maximised(m, np.arange(len(m.mean)), x)
            trials[g] = Mixture(m.parent, weight, mean, var, rows, step)
            if (now - likelihood[g]) / max(parents[int(m.parent[0])], 1.0) <= GAIN:
                open_.discard(g)
            likelihood[g] = now
        sent.unpersist()
        if not open_:
            break
    best: dict[int, tuple] = {}
    for g, m in enumerate(trials):
        p = int(m.parent[0])
        score = _bic(len(m.mean), m.mean.shape[1], parents[p], likelihood[g])
        if p not in best or score < best[p][0]:
            best[p] = (score, m)
    return [m for _, m in best.values()]


def fit_level(live: DataFrame, parents: list[tuple[int, float]], sizes: tuple[int, ...]) -> Mixture:
    """Fits the children of ``parents(component, rows)`` over all rows ``live(parent, z)`` and keeps, per parent, the number of components of least BIC."""
    spark = live.sparkSession
    # every parent has its own share, so that deep and small ones have as many seeds as the first
    rate = spark.createDataFrame([(p, min(1.0, SEED_ROWS / max(r, 1.0)), r > LOCAL_ROWS) for p, r in parents], "parent long, rate double, large boolean")
    keep = F.pmod(F.xxhash64(F.lit("seed"), "z"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    marked = live.join(F.broadcast(rate), "parent").withColumn("drawn", keep)  # a row per component to be split
    large = {p: r for p, r in parents if r > LOCAL_ROWS}
    own = live if len(large) == len(parents) else marked.where("large").select("parent", "z")
    parts = [_fitted(m) for m in (_by_jobs(own, marked.where("large and drawn").select("parent", "z"), large, sizes) if large else [])]
    if len(large) < len(parents):
        parts += [marked.where("not large").groupBy("parent").applyInPandas(_local(sizes), _FITTED).toPandas()]  # the model itself
    every = pd.concat(parts).sort_values("parent", kind="stable", ignore_index=True)
    values = lambda c: np.frombuffer(b"".join(every[c]), np.float64).reshape(len(every), -1)
    return Mixture(every["parent"].to_numpy().astype(int), every["weight"].to_numpy(), values("mean"), values("var"), every["rows"].to_numpy(), int(every["steps"].max()))


def _descend(sent, splits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the components that are split further, each with its component and its block in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, further = sent.value, splits
        d = model.mean.shape[1]
        for b in batches:
            parent, z = _rows_of(b, d)
            child = np.full(len(z), -1)
            for p, rows in _by(parent):
                kids = model.of.get(p)
                if kids is not None:
                    child[rows] = kids[model.log_density(z[rows], kids).argmax(1)]
            goes = np.flatnonzero(np.isin(child, further))
            yield pa.RecordBatch.from_arrays([pa.array(child[goes]), b.column("z").take(pa.array(goes))], names=["parent", "z"])

    return run


def _assign(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        d = levels[0].mean.shape[1]
        for b in batches:
            z = _floats(b.column("z"), d)
            leaf, density = route(levels, z)
            blocks = np.array([max(1, round(levels[x >> 32].rows[x & 0xFFFFFFFF] / BLOCK_ROWS + 0.5)) for x in leaf.tolist()], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), pa.array(leaf), pa.array(blocks), pa.array(density)], names=["id", "u", "leaf", "blocks", "density"])

    return run


_MEMBER = "id string, frag string, leaf long, density double, u binary"
_PACK = "u binary, starts binary, names array<string>, centre binary, radius binary"


def _alike(x: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors at or above the likeness, in blocks."""
    a, b = [], []
    for i in range(0, len(x), BLOCK_ROWS):
        for j in range(i, len(x), BLOCK_ROWS):
            p, q = np.nonzero(x[i : i + BLOCK_ROWS] @ x[j : j + BLOCK_ROWS].T >= likeness - 1e-6)
            off = p + i < q + j
            a.append(p[off] + i)
            b.append(q[off] + j)
    return np.concatenate(a), np.concatenate(b)


def _fragments(likeness: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "u"]).sort_values("id", ignore_index=True)
        out = []
        for i in range(0, len(pdf), 2 * BLOCK_ROWS):  # a block larger than planned is cut again
            part = pdf.iloc[i : i + 2 * BLOCK_ROWS]
            x = np.frombuffer(b"".join(part["u"]), np.float32).reshape(len(part), -1)
            label = local_components(len(x), *_alike(x, likeness))
            ids = part["id"].to_numpy()
            out.append(pd.DataFrame({"id": ids, "frag": ids[label], "leaf": key[0], "density": part["density"].to_numpy(), "u": part["u"]}))
        return pd.concat(out)

    return run


def _packs(dim: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in packs, ordered by fragment, with each fragment's centre and the angle to its farthest row; a fragment cut by a pack's end is two of one name."""

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frag", ignore_index=True)
        names, u = part["frag"].to_numpy(), b"".join(part["u"])
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]).astype(np.int32)
        p = _Pack(u, starts, names[starts], dim)
        return pd.DataFrame({"u": [u], "starts": [starts.tobytes()], "names": [names[starts].tolist()], "centre": [p.centre.tobytes()], "radius": [p.radius.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for i in range(0, len(pdf), PACK_ROWS):
                held.append(pdf.iloc[i : i + PACK_ROWS])
                if sum(map(len, held)) >= PACK_ROWS:
                    every = pd.concat(held)
                    yield packed(every.iloc[:PACK_ROWS])
                    held = [every.iloc[PACK_ROWS:]] if len(every) > PACK_ROWS else []
        if held:
            yield packed(pd.concat(held))

    return run


class _Pack:
    """The fragments of a pack: rows, centres, and the angle from each centre to its farthest row."""

    def __init__(self, u: bytes, starts: np.ndarray, names: np.ndarray, dim: int, centre: bytes | None = None, radius: bytes | None = None) -> None:
        self.x = np.frombuffer(u, np.float32).reshape(-1, dim)
        self.starts, self.names = np.asarray(starts), np.asarray(names, dtype=object)
        self.sizes = np.diff(np.r_[self.starts, len(self.x)])
        self.ends = self.starts + self.sizes
        if centre is not None:
            self.centre, self.radius = np.frombuffer(centre, np.float32).reshape(-1, dim), np.frombuffer(radius, np.float32)
            return
        total = np.add.reduceat(self.x, self.starts, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        # any unit vector will do as a centre; the mean is the best one unless the rows cancel out
        self.centre = np.where(norm > 1e-3, total / np.maximum(norm, 1e-3), self.x[self.starts])
        self.radius = np.arccos(np.minimum.reduceat((self.x * self.centre[np.repeat(np.arange(len(self.starts)), self.sizes)]).sum(1), self.starts).clip(-1, 1))


def _near(p: _Pack, q: _Pack, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fragments whose centres are within the sum of their radii and ``reach``."""
    a = p.radius + np.float32(reach)
    # cos(a + b) is a product of two entries more, so that one matrix product compares all pairs
    left = np.c_[p.centre, -np.cos(a), np.sin(a)]
    right = np.c_[q.centre, np.cos(q.radius), np.sin(q.radius)]
    near = left @ right.T >= -1e-5
    wide = np.flatnonzero(a + q.radius.max() >= WIDE)
    near[wide] |= a[wide, None] + q.radius[None, :] >= WIDE
    return np.divmod(np.flatnonzero(near), near.shape[1])


def _touching(p: _Pack, q: _Pack, f: np.ndarray, g: np.ndarray, reach: float) -> np.ndarray:
    """Of the pairs ``f[k], g[k]``, ordered by ``f``, those with a row of ``f`` within the radius of ``g`` and ``reach``."""
    least = np.cos(np.minimum(q.radius + reach, np.pi))
    sizes = p.sizes[f]
    own, other = np.unique(f), np.unique(g)
    if int(sizes.sum()) * 8 >= int(p.sizes[own].sum()) * len(other):  # most pairs of these fragments are near
        out, n = np.zeros(len(f), bool), p.sizes[own]
        step = max(1, NEAR_ROWS * 16 // len(other))
        cut = np.flatnonzero(np.r_[True, np.diff(np.cumsum(n) // step) > 0])
        for i, j in zip(cut, np.r_[cut[1:], len(own)]):
            rows = np.concatenate([np.arange(p.starts[k], p.ends[k]) for k in own[i:j]])
            close = p.x[rows] @ q.centre[other].T >= least[other]
            close = np.logical_or.reduceat(close, np.r_[0, np.cumsum(n[i:j])[:-1]], axis=0)
            some = slice(np.searchsorted(f, own[i]), np.searchsorted(f, own[j - 1], "right"))
            out[some] = close[np.searchsorted(own[i:j], f[some]), np.searchsorted(other, g[some])]
        return out
    out = []
    cut = np.flatnonzero(np.r_[True, np.diff(np.cumsum(sizes) // NEAR_ROWS) > 0])
    for i, j in zip(cut, np.r_[cut[1:], len(f)]):
        n, at = sizes[i:j], np.r_[0, np.cumsum(sizes[i:j])[:-1]]
        rows = np.repeat(p.starts[f[i:j]] - at, n) + np.arange(n.sum())
        to = np.repeat(g[i:j], n)
        close = np.einsum("ij,ij->i", p.x[rows], q.centre[to]) >= least[to]
        out.append(np.logical_or.reduceat(close, at))
    return np.concatenate(out)


def _pack_edges(p: _Pack, q: _Pack, same: bool, likeness: float) -> list[tuple[str, str]]:
    """Edges between fragments that hold two alike rows, without those that follow from others."""
    reach = np.arccos(likeness) + SLACK
    f, g = _near(p, q, reach)
    kept = (f < g) & (p.names[f] != q.names[g]) if same else p.names[f] != q.names[g]
    f, g = f[kept], g[kept]
    if not len(f):
        return []
    kept = _touching(p, q, f, g, reach)
    up: dict[str, str] = {}

    def find(k: str) -> str:
        while up.get(k, k) != k:
            k = up[k]
        return k

    out = []
    for i, j in zip(f[kept].tolist(), g[kept].tolist()):
        a, b = find(p.names[i]), find(q.names[j])
        if a != b and (p.x[p.starts[i] : p.ends[i]] @ q.x[q.starts[j] : q.ends[j]].T).max() >= likeness - 1e-6:
            up[max(a, b)] = min(a, b)
            out.append((p.names[i], q.names[j]))
    return out


def _across(likeness: float, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(b: pa.RecordBatch, k: int, side: str) -> _Pack:
        u, starts, centre, radius = (b.column(c + side)[k].as_buffer() for c in ("u", "starts", "centre", "radius"))
        return _Pack(u, np.frombuffer(starts, np.int32), np.array(b.column("names" + side)[k].as_py(), dtype=object), dim, centre, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p = None, None
        for b in batches:
            for k, (i, j) in enumerate(zip(b.column("i").to_pylist(), b.column("j").to_pylist())):
                if i != at:
                    at, p = i, pack(b, k, "")
                edges = _pack_edges(p, p if j == i else pack(b, k, "2"), j == i, likeness)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*edges)], names=["a", "b"])

    return run


def _joined(members: DataFrame, work: Work, likeness: float, dim: int) -> DataFrame:
    """Edges ``(a, b)`` between the fragments of ``members``: every pack meets every other without a shuffle."""
    packs = work.table(members.select("frag", "u").mapInPandas(_packs(dim), _PACK).withColumn("i", F.monotonically_increasing_id()), "packs")
    other = packs.select(F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in packs.columns if c != "i"])
    pairs = packs.crossJoin(other).where("i <= j")
    # a pair of packs is some 8 MB: one in a batch
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = members.sparkSession.conf.get(key)
    members.sparkSession.conf.set(key, PACK_PAIRS)
    try:
        return work.table(pairs.mapInArrow(_across(likeness, dim), "a string, b string"), "joined")
    finally:
        members.sparkSession.conf.set(key, before)


def _together(rows: DataFrame, parents: list[tuple[int, float]]) -> DataFrame:
    """``rows(parent, z)`` with those of a component in one partition, or in several if they are many."""
    blocks = rows.sparkSession.createDataFrame([(k, int(r // (8 * LEAF_ROWS)) + 1) for k, r in parents], "parent long, blocks int")
    dealt = rows.join(F.broadcast(blocks), "parent").withColumn("block", F.pmod(F.xxhash64("z"), F.col("blocks")))  # a row per component to be split
    return dealt.repartition("parent", "block").select("parent", "z")


def similarity_clusters(rows: DataFrame, work: Work, likeness: float = LIKENESS) -> DataFrame:
    """``rows(id, vector)`` -> ``(cluster_key, id, component, density)``, the key being the smallest id of the cluster.

    Null and all-zero vectors, vectors with null or infinite entries, null ids, and vectors whose number of
    entries is not the most frequent one are like nothing and left out. Repeated rows count once; an
    id with several vectors is a member of the cluster of each. A vector like no other is a cluster of one.
    Clusters are the connected components of likeness over all rows, whatever leaves they fall in. No usable vector
    gives an empty result.
    """
    given = rows.where("id is not null and vector is not null").select("id", "vector")
    sizes = given.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0].dim if sizes and sizes[0].dim > 0 else 0
    total = _total(given.mapInArrow(_moments(dim), "data binary")) if dim else None
    empty = given.sparkSession.createDataFrame([], "cluster_key string, id string, component long, density double")
    if total is None:
        return empty
    n, mean = total[0], total[1 : 1 + dim] / total[0]
    cov = total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, axes = np.linalg.eigh(cov / np.outer(std, std))
    top = np.argsort(-values)[: min(DIMS, dim)]
    to = axes[:, top] / std[:, None]
    features = work.table(given.mapInArrow(_features(dim, mean, to), "id string, u binary, z binary"), "features")

    spark = given.sparkSession
    levels: list[Mixture] = []
    parents, trial = [(-1, float(n))], FIRST
    live = features.select(F.lit(-1).cast("long").alias("parent"), "z")
    while parents and len(levels) < MAX_LEVELS:
        levels.append(fit_level(live, parents, trial))
        # a component that did not come apart (one dense cluster) is a leaf of several blocks
        before = dict(parents)
        rows = levels[-1].rows
        parents, trial = [(k, float(r)) for k, r in enumerate(rows) if r > LEAF_ROWS and r < 0.9 * before[int(levels[-1].parent[k])]], FURTHER
        if parents:
            splits = np.array([k for k, _ in parents])
            down = live.mapInArrow(_descend(spark.sparkContext.broadcast(levels[-1]), splits), "parent long, z binary")
            # rows of a component lie together, a large one in several blocks
            live = work.table(_together(down, parents), "live")

    sent = spark.sparkContext.broadcast(levels)
    placed = features.select("id", "u", "z").mapInArrow(_assign(sent), "id string, u binary, leaf long, blocks int, density double")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    members = work.table(placed.groupBy("leaf", "block").applyInPandas(_fragments(likeness), _MEMBER), "members")
    joined = _joined(members, work, likeness, dim)
    same = connected_components(joined, work).select(F.col("node").alias("frag"), "label")
    return members.join(same, "frag", "left").select(F.coalesce("label", "frag").alias("cluster_key"), "id", F.col("leaf").alias("component"), "density").distinct()


def describe(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster_key, n_members, typical)``: size and the ids of highest density, ties by id."""
    sizes = clusters.groupBy("cluster_key").agg(F.count_distinct("id").alias("n_members"))
    one = clusters.groupBy("cluster_key", "id").agg(F.max("density").alias("density"))
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("density"), "id"))
    best = one.withColumn("rank", rank).where(F.col("rank") <= typical).groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("best"))
    return sizes.join(best, "cluster_key").select("cluster_key", "n_members", F.col("best.id").alias("typical"))
