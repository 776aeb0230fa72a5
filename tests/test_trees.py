import random
import tracemalloc

import numpy as np
import pandas as pd

from docspark.operators import trees

CHUNKS = "paper_id string, chunk_id string, section_hierarchy array<string>, section_title string, first_order int"


def test_structural_clusters(spark):
    rows, n = [], 0
    for section, size, subs in (("1 Small", 2, 1), ("2 Normal", 5, 1), ("3 Tiny", 1, 1), ("4 Large", 14, 1), ("5 Parts", 15, 3), ("6 Last", 2, 1)):
        for i in range(size):
            rows.append(("p", f"c{n:03d}", [section, f"s{i % subs}"] if subs > 1 else [section], section, n))
            n += 1
    rows.append(("q", "only", None, None, None))
    out = trees.structural_clusters(spark.createDataFrame(rows, CHUNKS)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        sizes.setdefault((r.paper_id, r.cluster_no), set()).add(r.chunk_id)
        assert r.n_in_cluster >= 1
    # 2 small wait for the normal one, the tiny one joins it, halves of 7, three parts of 5, the last joins the last part
    assert sorted(len(v) for (p, _), v in sizes.items() if p == "p") == [5, 5, 7, 7, 7, 8]
    assert ("q", 0) in sizes


def test_structural_clusters_empty(spark):
    assert trees.structural_clusters(spark.createDataFrame([], CHUNKS)).count() == 0


def test_fuzzy_memberships(spark, work):
    rng = np.random.default_rng(1)
    x = [("p", f"c{i}", [float(v) for v in rng.normal(5 * (i % 2), 0.2, 3)]) for i in range(20)] + [("lone", "z", [1.0, 2.0, 3.0])]
    start = [(p, c, (int(c[1:]) % 2 if p == "p" else 0)) for p, c, _ in x]
    out = trees.fuzzy_clusters(spark.createDataFrame(x, "paper_id string, chunk_id string, vector array<double>"), spark.createDataFrame(start, "paper_id string, chunk_id string, cluster int"), work, 3).collect()
    assert {r.chunk_id: r.cluster for r in out} == {c: k for p, c, k in start if p == "p"}
    assert all(0.25 <= r.score <= 1 for r in out)


def settled(v, hard):
    """Plain fuzzy c-means: principal components, then steps until the memberships settle; also the number of steps."""
    n, d = v.shape
    v = v - v.mean(0)
    values, axes = np.linalg.eigh(v.T @ v)
    v = v @ axes[:, np.argsort(-values)[: min(50, max(2, n // 5), d, n - 1)]]
    k = max(hard) + 1
    u = np.array([[float(h == j) for j in range(k)] for h in hard])
    for step in range(1, 151):
        c = [sum(u[i, j] ** 2 * v[i] for i in range(n)) / sum(u[i, j] ** 2 for i in range(n)) for j in range(k)]
        far = np.array([[max(((v[i] - c[j]) ** 2).sum(), 1e-10) for j in range(k)] for i in range(n)])
        new = np.array([[1 / sum((far[i, j] / far[i, m]) ** 2 for m in range(k)) for j in range(k)] for i in range(n)])
        change, u = np.abs(new - u).max(), new
        if change < 1e-4:
            break
    return u, step


def test_fuzzy_memberships_settle_on_overlapping_clusters(spark, work):
    rng = np.random.default_rng(8)
    v = {p: rng.normal(size=(n, 12)) + 1.5 * np.eye(12)[[i % 3 for i in range(n)]] for p, n in (("p", 40), ("q", 7))}
    hard = {p: [(i // 2) % 3 for i in range(len(a))] for p, a in v.items()}
    x = [(p, f"c{i:02d}", a[i].tolist()) for p, a in v.items() for i in range(len(a))]
    start = [(p, f"c{i:02d}", h) for p, a in hard.items() for i, h in enumerate(a)]
    out = trees.fuzzy_clusters(spark.createDataFrame(x, "paper_id string, chunk_id string, vector array<double>"), spark.createDataFrame(start, "paper_id string, chunk_id string, cluster int"), work, 12).collect()
    want, steps = {}, []
    for p in v:
        u, n = settled(v[p], hard[p])
        steps.append(n)
        for i in range(len(u)):
            for k in sorted(range(3), key=lambda k: -u[i, k])[:2]:
                if u[i, k] >= 0.25:
                    want[p, f"c{i:02d}", k] = u[i, k]
    got = {(r.paper_id, r.chunk_id, r.cluster): r.score for r in out}
    assert max(steps) > 5
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_memberships_sum_to_one(spark):
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([("p", f"c{i}", rng.random(3).tolist()) for i in range(5)], "paper_id string, chunk_id string, vector array<double>")
    c = spark.createDataFrame([("p", k, rng.random(3).tolist()) for k in range(2)], "paper_id string, cluster int, centre array<double>")
    sums = {}
    for r in trees.memberships(x, c).collect():
        sums[r.chunk_id] = sums.get(r.chunk_id, 0) + r.u
    assert all(abs(v - 1) < 1e-9 for v in sums.values())


def test_semantic_dedup(spark, work):
    rng = np.random.default_rng(3)
    a = rng.normal(size=16)
    nodes = [
        ("p", "n1", a.tolist(), 10, ["1", "2"]),
        ("p", "n2", (a + 1e-4).tolist(), 20, ["2", "3"]),
        ("p", "n3", rng.normal(size=16).tolist(), 5, None),
        ("p", "n4", None, None, []),
        ("q", "n5", a.tolist(), 1, ["9"]),
    ]
    out = trees.semantic_dedup(spark.createDataFrame(nodes, "paper_id string, chunk_id string, vector array<double>, token_count int, children array<string>"), work).collect()
    assert {r.chunk_id: r.kept_as for r in out} == {"n1": "n2", "n2": "n2", "n3": "n3", "n4": "n4", "n5": "n5"}
    assert next(r.n_children for r in out if r.chunk_id == "n2") == 3


def test_group_evenly(spark):
    rng = random.Random(4)
    for n in (2, 5, 9, 13):
        ids = [f"{i:02d}" for i in range(n)]
        rng.shuffle(ids)
        out = trees.group_evenly(spark.createDataFrame([("p", i) for i in ids], "paper_id string, chunk_id string"), "paper_id", ["chunk_id"]).collect()
        groups = min(3, max(2, n // 3))
        size = -(-n // groups)
        assert {r.chunk_id: r.group_no for r in out} == {f"{i:02d}": i // size for i in range(n)}


def test_memberships_leave_a_block_in_frames_of_bounded_size():
    k, rng = 1500, np.random.default_rng(5)
    ids, centres = np.array([f"c{i:05d}" for i in range(1000)], dtype=object), rng.normal(size=k * 16)
    block = pd.DataFrame({"grp": ["p"], "x_ids": [ids], "x_data": [rng.normal(size=16_000)], "clusters": [np.arange(k)], "centres": [centres]})
    frames = list(trees._pulls(2.0, 1e-10)(iter([block])))
    assert [c for f in frames for c in f["chunk_id"]] == ids.tolist()
    pairs = [sum(map(len, f["us"])) for f in frames]
    assert sum(pairs) == 1000 * k and max(pairs) <= trees.FUZZY_PAIRS + k


def test_memberships_of_a_hot_paper_are_never_held_at_once():
    n, k = 3000, 1500
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"paper_id": "p", "chunk_id": [f"c{i:05d}" for i in range(n)], "cluster": (np.arange(n) % k).astype(float), "vector": list(rng.normal(size=(n, 16)))})
    tracemalloc.start()
    trees._fuzzy(2, 1e-4, 0.25)(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * k * 8


def test_a_hot_paper_settles_by_jobs_as_in_one_task(spark, work, monkeypatch):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(90, 12)) + 1.5 * np.eye(12)[[i % 3 for i in range(90)]]
    x = [("p" if i < 60 else "q", f"c{i:02d}", a.tolist()) for i, a in enumerate(v)] + [("p", "hole", [None] + [1.0] * 11), ("p", "far", [float("inf")] * 12)]
    start = [(p, c, int(c[1:]) // 2 % 3 + 4) for p, c, _ in x[:90] if c != "c07"] + [("p", "hole", 9)]
    given = spark.createDataFrame(x, "paper_id string, chunk_id string, vector array<double>"), spark.createDataFrame(start, "paper_id string, chunk_id string, cluster int")
    calls, by_jobs, out = [], trees._fuzzy_by_jobs, []
    monkeypatch.setattr(trees, "_fuzzy_by_jobs", lambda *a: calls.append(1) or by_jobs(*a))
    for pairs in (10**6, 150):
        monkeypatch.setattr(trees, "LOCAL_PAIRS", pairs)
        out.append({(r.paper_id, r.chunk_id, r.cluster): r.score for r in trees.fuzzy_clusters(*given, work, 12).collect()})
    assert len(calls) == 1 and any(p == "p" for p, _, _ in out[0])
    assert out[0].keys() == out[1].keys()
    assert all(abs(out[0][k] - out[1][k]) <= 1e-4 for k in out[0])


def test_driver_gets_the_centres_of_a_step_once(spark, work, monkeypatch):
    rng = np.random.default_rng(12)
    n, k, dims, sent = 400, 80, 6, []
    x = [("p", f"c{i:03d}", row.tolist()) for i, row in enumerate(rng.normal(size=(n, dims)))]
    points = spark.createDataFrame([(*r, i % k) for i, r in enumerate(x)], "paper_id string, chunk_id string, vector array<double>, cluster long").repartition(4)
    collect = type(points).collect

    def counted(df):
        rows = collect(df)
        sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(points), "collect", counted)
    monkeypatch.setattr(trees, "TILE", (16, 32), raising=False)
    u = trees._fuzzy_by_jobs(points, work, dims, 3, 1e-4, 0.0, "paper_id string, chunk_id string, cluster long, u double")
    assert max(sent) <= 8 * k * (dims + 1)
    monkeypatch.undo()
    own = points.toPandas()
    want = {(r.chunk_id, r.cluster): r.u for r in trees._fuzzy(3, 1e-4, 0.0)(own).itertuples()}
    got = {(r.chunk_id, r.cluster): r.u for r in u.collect()}
    assert got.keys() == want.keys() and len(got) == n * k
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_blocks_without_a_membership_in_a_paper_settled_by_jobs(spark, work):
    rng = np.random.default_rng(13)
    # rows of two kinds by id: some on a centre of their own, hundreds that belong to no cluster by a quarter
    near, far = 20 * np.eye(8), rng.normal(size=(600, 8))
    rows = [("p", f"a{i}{c}", near[i].tolist(), i) for i in range(8) for c in "xyz"] + [("p", f"b{i:03d}", v.tolist(), 8 + i % 60) for i, v in enumerate(far)]
    points = spark.createDataFrame(rows, "paper_id string, chunk_id string, vector array<double>, cluster long")
    u = trees._fuzzy_by_jobs(points, work, 8, 4, 1e-4, 0.25, "paper_id string, chunk_id string, cluster long, u double")
    want = {(r.chunk_id, r.cluster): r.u for r in trees._fuzzy(4, 1e-4, 0.25)(points.toPandas()).itertuples()}
    got = {(r.chunk_id, r.cluster): r.u for r in u.collect()}
    assert got.keys() == want.keys() and len({c for c, _ in got}) < len(rows) / 2
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    none = trees._fuzzy_by_jobs(points, work, 8, 4, 1e-4, 1.1, "paper_id string, chunk_id string, cluster long, u double")
    assert none.collect() == []
