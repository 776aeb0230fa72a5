import time

import numpy as np
import pandas as pd
import pytest

from docspark.llm import clusters
from docspark.operators.components import local_components

SCHEMA = "id string, vector array<double>, leaf string"


def make(seed, sizes, dim=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for n in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(n):
            v = c + rng.normal(size=dim) * 0.25 / np.sqrt(dim)
            rows.append((f"v{k:05d}", (v * rng.uniform(0.1, 4)).tolist(), "x"))
            k += 1
    return rows


def brute(rows, dim):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v) / np.abs(v).max()
            ok[i] = v / np.linalg.norm(v)
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids])
    a, b = np.nonzero(np.triu(x @ x.T >= 0.8, 1))
    label = local_components(len(ids), a, b)
    return {i: ids[label[k]] for k, i in enumerate(ids)}


@pytest.mark.parametrize("leaf, block", [(1500, 2048), (30, 16)])
def test_against_brute_force(spark, work, monkeypatch, leaf, block):
    monkeypatch.setattr(clusters, "LEAF_ROWS", leaf)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", block)
    rows = make(1, [1] * 40 + [3, 5, 9, 20, 40, 150])
    rows += [("null", None, "x"), ("zero", [0.0] * 16, "x"), ("short", [1.0, 2.0], "x"), ("hole", [1.0] * 15 + [None], "x"), (None, [1.0] * 16, "x"), rows[60], ("tiny", [1e-300] + [0.0] * 15, "x")]
    out = clusters.similarity_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), work).collect()
    got = {r.id: r.cluster_key for r in out}
    want = brute(rows, 16)
    assert len(out) == len(got)
    assert got.keys() == want.keys()
    assert np.mean([got[i] == want[i] for i in want]) >= (1.0 if leaf == 1500 else 0.98)


def test_every_pair_of_leaves_is_compared(spark, work, monkeypatch):
    """Chains of alike rows that the mixture cuts into many small leaves, their ends far apart, come out whole."""
    monkeypatch.setattr(clusters, "LEAF_ROWS", 20)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 16)
    monkeypatch.setattr(clusters, "PACK_ROWS", 50, raising=False)
    rng = np.random.default_rng(5)
    rows = make(4, [1] * 60 + [4] * 30 + [60, 120])
    for k in range(3):
        a, b = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
        rows += [(f"w{k}{i:03d}", (np.cos(t) * a + np.sin(t) * b + rng.normal(size=16) * 0.02).tolist(), "x") for i, t in enumerate(np.linspace(0, np.pi, 60))]
    out = clusters.similarity_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), work).collect()
    assert {r.id: r.cluster_key for r in out} == brute(rows, 16)


def test_mostly_single_rows_and_three_levels(spark, work, monkeypatch):
    monkeypatch.setattr(clusters, "LEAF_ROWS", 15)
    monkeypatch.setattr(clusters, "LOCAL_ROWS", 100)
    monkeypatch.setattr(clusters, "FIRST", (4, 8))
    monkeypatch.setattr(clusters, "FURTHER", (3, 4))  # the criterion would leave rows like no other in one component
    fitted, fit = [], clusters.fit_level
    monkeypatch.setattr(clusters, "fit_level", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    rows = make(6, [1] * 900 + [5] * 40 + [80])
    out = clusters.similarity_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), work).collect()
    assert len(fitted) >= 3
    assert {r.id: r.cluster_key for r in out} == brute(rows, 16)  # recall against brute force is 1


def test_description(spark, work):
    rows = make(2, [12, 5, 1])
    c = work.table(clusters.similarity_clusters(spark.createDataFrame(rows, SCHEMA), work), "c")
    out = {r.cluster_key: r for r in clusters.describe(c).collect()}
    assert sorted(r.n_members for r in out.values()) == [1, 5, 12]
    density = {r.id: r.density for r in c.collect()}
    members = {}
    for r in c.collect():
        members.setdefault(r.cluster_key, []).append(r.id)
    for k, r in out.items():
        assert list(r.typical) == sorted(members[k], key=lambda i: (-density[i], i))[:3]


@pytest.mark.parametrize("local", [10_000, 100])
def test_mixture_finds_the_number_of_components(spark, work, monkeypatch, local):
    monkeypatch.setattr(clusters, "LOCAL_ROWS", local)
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.normal(c, 0.1, (200, 4)) for c in ([0] * 4, [5] * 4, [0, 5, 0, 5])]).astype(np.float32)
    f = spark.createDataFrame([(-1, bytearray(v.tobytes())) for v in z], "parent long, z binary").repartition(2)
    m = clusters.fit_level(f, [(-1, float(len(z)))], (1, 3, 12))
    assert len(m.mean) == 3 and abs(m.weight.sum() - 1) < 1e-6
    assert sorted(m.rows.round().tolist()) == [200, 200, 200] and m.steps < clusters.MOST_STEPS


def test_fit_in_one_task_equals_fit_by_jobs(spark, work, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(p, bytearray((rng.normal(size=3) + 3 * p * (rng.random() < 0.4)).astype(np.float32).tobytes())) for p in (1, 2) for _ in range(300)]
    f = spark.createDataFrame(rows, "parent long, z binary").repartition(3)
    out = []
    for local in (10_000, 10):
        monkeypatch.setattr(clusters, "LOCAL_ROWS", local)
        out.append(clusters.fit_level(f, [(1, 300.0), (2, 300.0)], (1, 2, 4)))
    assert (out[0].parent == out[1].parent).all() and out[0].steps == out[1].steps
    for c in ("weight", "mean", "var", "rows"):
        assert np.allclose(getattr(out[0], c), getattr(out[1], c), atol=1e-6)


def test_empty(spark, work):
    assert clusters.similarity_clusters(spark.createDataFrame([], SCHEMA), work).count() == 0
    assert clusters.similarity_clusters(spark.createDataFrame([("a", [0.0, 0.0], "x"), ("b", None, "x")], SCHEMA), work).count() == 0


def packs_of(rows, frags):
    given = pd.DataFrame({"frag": frags, "u": [r.tobytes() for r in rows]})
    return [clusters._Pack(r.u, np.frombuffer(r.starts, np.int32), r.names, rows.shape[1], r.centre, r.radius) for f in clusters._packs(rows.shape[1])(iter([given])) for r in f.itertuples()]


def test_packs_without_near_fragments_cost_little_more_than_one_product():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 256)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    p, q = (packs_of(x[i : i + 3000], [f"f{i + k:05d}" for k in range(3000)])[0] for i in (0, 3000))
    times = {}
    for name, f in (("product", lambda: x[:3000] @ x[3000:].T), ("edges", lambda: clusters._pack_edges(p, q, False, 0.8))):
        each = []
        for _ in range(5):
            began = time.process_time()
            f()
            each.append(time.process_time() - began)
        times[name] = min(each)
    assert clusters._pack_edges(p, q, False, 0.8) == []
    assert times["edges"] < 3 * times["product"]


@pytest.mark.parametrize("noise, near_rows", [(0.02, 1 << 16), (0.4, 1 << 16), (1.2, 40)])
def test_no_alike_rows_of_two_packs_are_passed_over(monkeypatch, noise, near_rows):
    monkeypatch.setattr(clusters, "NEAR_ROWS", near_rows)
    rng = np.random.default_rng(10)
    k = rng.integers(0, 40, 800)
    x = (rng.normal(size=(40, 4))[k] + noise * rng.normal(size=(800, 4))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    p, q = (packs_of(x[i : i + 400], [f"f{i}-{n:02d}" for n in k[i : i + 400]])[0] for i in (0, 400))
    got = clusters._pack_edges(p, q, False, 0.8)
    names = sorted({*p.names, *q.names})
    at = {n: i for i, n in enumerate(names)}
    row = np.array([at[f"f{i // 400 * 400}-{n:02d}"] for i, n in enumerate(k)])
    a, b = np.nonzero(x[:400] @ x[400:].T >= 0.8 - 1e-6)
    label = lambda pairs: local_components(len(names), *np.array(pairs).reshape(-1, 2).T).tolist()
    assert label([(at[a], at[b]) for a, b in got]) == label(np.c_[row[a], row[b + 400]])
