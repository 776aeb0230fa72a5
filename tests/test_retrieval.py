import numpy as np
from pyspark.sql import functions as F

from docspark.operators import knn, relational, retrieval


def test_knn_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROW_BLOCK", 40)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 8))
    x[3] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<double>")
    got = {(r.query_id, r.rank): r.id for r in knn.top_k(rows.where("id % 10 = 0"), rows, 4).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 6)
    want = {(q, k + 1): int(i) for q in range(0, 150, 10) for k, i in enumerate(sorted(range(150), key=lambda i: (-s[q, i], i))[:4])}
    assert got == want


def test_similar_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4))
    x[7] = 0
    rows = [("g" if i % 3 else "h", f"i{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("g", "null", None), (None, "lost", [1.0] * 4), ("g", "long", [1.0] * 5), ("g", "hole", [1.0, None, 1.0, 1.0])]
    got = {(r.a, r.b) for r in knn.similar_pairs(spark.createDataFrame(rows, "grp string, id string, vector array<double>"), 0.6).collect()}
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {(rows[i][1], rows[j][1]) for i in range(90) for j in range(i + 1, 90) if rows[i][0] == rows[j][0] and round(float(u[i] @ u[j]), 6) >= 0.6}
    assert got == want


def test_fill_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", 1, "a", 60), ("q", 2, "b", 50), ("q", 3, "c", 40), ("q", 4, "d", 1), ("e", 1, "x", 500)], "query_id string, o int, item string, size int")
    out = {r.query_id: r for r in retrieval.fill_budget(rows, "query_id", [F.col("o")], F.col("size"), F.col("item"), 100).collect()}
    assert out["q"].included == ["a", "c"] and out["q"].used == 100 and out["q"].dropped == 2
    assert out["e"].included == [] and out["e"].dropped == 1


def test_pages_concatenate_to_the_full_order(spark):
    rows = spark.createDataFrame([("u", None if i % 5 == 0 else i % 7, f"id{i:02d}") for i in range(23)], "user string, value int, id string")
    order = [F.col("value").desc_nulls_last(), F.col("id").desc()]
    full = [r.id for r in rows.orderBy(*order).collect()]
    page = relational.top_per_group(rows, ["user"], order, 5)
    seen = []
    while True:
        got = page.orderBy("place").collect()
        seen += [r.id for r in got]
        if len(got) < 5:
            break
        cursor = spark.createDataFrame([("u", got[-1].value, got[-1].id)], "user string, last_value int, last_id string")
        page = relational.next_page(rows, cursor, "user", "value", "id", 5)
    assert seen == full


def test_second_insert_writes_nothing(spark):
    rows = spark.createDataFrame([("p", "h1"), ("p", "h1"), ("p", "h2"), ("q", None)], "paper string, hash string")
    stored = relational.insert_new(rows, rows.limit(0), ["paper", "hash"], within=True)
    assert stored.count() == 3
    assert relational.insert_new(rows.where("hash is not null"), stored, ["paper", "hash"]).count() == 0
