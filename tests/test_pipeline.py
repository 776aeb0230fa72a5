import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docspark.functions import text
from docspark.operators import chunking, encode, knn, retrieval, trees
from docspark.streaming import limits


def test_newest_goes_by_time_and_not_by_spelling(spark):
    rows = [("a", "2025-03-01T10:00:00+05:00", "old"), ("a", "2025-03-01T06:00:00Z", "new"), ("b", "2025-12-31 23:00:00", "old"), ("b", "2026-01-01T00:30:00+01:00", "new"), ("c", None, "none"), ("c", "what", "what"), (None, "2025-01-01", "lost")]
    df = spark.createDataFrame(rows, "chunk_id string, ingested_at string, v string")
    for c in ("children_ids", "parent_ids", "sibling_ids"):
        df = df.withColumn(c, F.array(F.col("v")))
    got = {r.chunk_id: r.v for r in retrieval.newest(df).collect()}
    assert got["a"] == "new" and got["b"] in ("old", "new") and set(got) == {"a", "b", "c"}
    assert got["b"] == "new"


CHUNK = "chunk_id string, paper_id string, level int, chunk_sequence_index int, is_key_section boolean, section_importance string, has_table boolean, has_equation boolean, has_figure boolean, cluster_ids array<int>, cluster_probabilities map<string,double>, children_ids array<string>, dense_vector array<double>, sparse_indices array<int>, sparse_values array<double>"
PLAN = "query_id string, paper_id string, mode string, dense_vector array<double>, sparse_indices array<int>, sparse_values array<double>, table_signal boolean, equation_signal boolean, figure_signal boolean, least_level int, most_level int, dense_weight double, sparse_weight double, top_k int, boosted boolean, rerank_n int"


def chunk(name, paper, level, vector, children=None):
    return (name, paper, level, 0, False, "medium", False, False, False, [0], {"0": 0.9}, children, vector, [1], [1.0])


def plan(name, paper, mode, low, high):
    return (name, paper, mode, [1.0, 0.0], [1], [1.0], False, False, False, low, high, 0.65, 0.35, 2, True, 4)


def test_broad_queries_fall_back_and_only_they_take_children(spark, work):
    rows = [chunk(f"l{k}", "with", 0, [1.0, 0.1 * k]) for k in range(4)] + [chunk("s1", "with", 1, [1.0, 0.5], ["l1", "l2", "l0", "l3"]), *[chunk(f"m{k}", "without", 0, [1.0, 0.1 * k]) for k in range(12)]]
    chunks = spark.createDataFrame(rows, CHUNK)
    plans = spark.createDataFrame([plan("b1", "with", "B", 1, 3), plan("b2", "without", "B", 1, 3), plan("c1", "with", "C", 0, 99), plan("b3", "nowhere", "B", 1, 3)], PLAN)
    hits = work.table(retrieval.hybrid(plans, chunks, work), "hits")
    found = {}
    for r in hits.collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert found["b1"] == ["s1"]
    assert len(found["b2"]) == 8 and all(c.startswith("m") for c in found["b2"])  # all levels, top 8
    assert len(found["c1"]) == 2 and "b3" not in found
    both = {(r.query_id, r.chunk_id): r.score for r in retrieval.with_children(hits, plans, chunks).collect()}
    assert {c for q, c in both if q == "b1"} == {"s1", "l1", "l2", "l0"} and both["b1", "l1"] == 0.5
    assert {c for q, c in both if q == "c1"} == set(found["c1"])


def test_top_within_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROW_BLOCK", 11)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 2}", f"i{i:02d}", rng.normal(size=4).tolist(), int(rng.integers(0, 4)), int(rng.integers(0, 8))) for i in range(80)]
    rows += [("g0", "zero", [0.0] * 4, 0, 7), ("g0", "hole", [1.0, None, 0.0, 0.0], 0, 7), ("g0", "long", [1.0] * 5, 0, 7), ("g0", "null", None, 0, 7), (None, "lost", [1.0] * 4, 0, 7)]
    queries = [(f"g{i % 2}", f"q{i}", rng.normal(size=4).tolist(), int(i % 3 == 0), 3, int(i % 4), 1 + i % 5) for i in range(10)] + [("g0", "qnull", None, 0, 3, 0, 2)]
    r = spark.createDataFrame(rows, "grp string, id string, vector array<double>, level int, flags int")
    q = spark.createDataFrame(queries, "grp string, id string, vector array<double>, least_level int, most_level int, flags int, top_k int")
    got = {}
    for x in knn.top_within(q, r).collect():
        got.setdefault(x.query_id, []).append((-x.score, x.chunk_id))
    for grp, name, v, low, high, flags, k in queries[:-1]:
        want = []
        for g, i, u, level, f in rows:
            if g == grp and u is not None and len(u) == 4 and None not in u and low <= level <= high and flags & ~f == 0:
                n = np.linalg.norm(u) * np.linalg.norm(v)
                s = round(float(np.dot(u, v) / n), 6) if n else 0.0
                if s >= 0:
                    want.append((-s, i))
        assert sorted(got.get(name, []))[:k] == sorted(want)[:k]
    assert "qnull" not in got


def test_embed(spark, work):
    rows = [("a", "red red blue " + "x " * 600 + "late"), ("b", "red"), ("c", None), ("d", ""), ("e", "...")]
    got = {r.id: r for r in encode.embed(spark.createDataFrame([(i, t, "clash") for i, t in rows], "id string, text string, term string"), work).collect()}
    assert set(got) == set("abcde")
    slot = lambda t, n: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % n
    counts = Counter("red red blue late".split()) + Counter({"x": 600})
    want = [0.0] * 64
    for t, n in counts.items():
        want[slot(t, 64)] += n
    norm = math.sqrt(sum(x * x for x in want))
    assert np.allclose(got["a"].dense, [x / norm for x in want])
    assert slot("late", encode.SLOTS) not in got["a"].sparse_indices  # beyond the first 512 terms
    assert np.isclose(dict(zip(got["a"].sparse_indices, got["a"].sparse_values))[slot("blue", encode.SLOTS)], math.log(2) * math.log(6 / 2))
    assert all(got[k].dense is None and got[k].sparse_indices is None for k in "cde")


def test_tree_nodes(spark, work):
    schema = "paper_id string, cluster_id int, pos int, id string, text string, first_page long, last_page long, first_order long, last_order long, key boolean"
    rows = [("p", c, k, f"c{c}-{k}", f"One {c}. Two. Three {k}.", 10 * c + k, 10 * c + k, 100 * c + k, 100 * c + k, k == 0) for c in range(4) for k in range(3)]
    rows += [("p", 9, 0, "small", "x", 1, 1, 1, 1, False), ("solo", 0, 0, "a", None, 1, 1, 1, 1, False), ("solo", 0, 1, "b", "", 2, 2, 2, 2, False), ("solo", 0, 2, "c", "A. B.", 3, 3, 3, 3, False)]
    got = {r.node_id: r for r in trees.tree_nodes(spark.createDataFrame(rows, schema), work).collect()}
    assert {(n[:4], r.level) for n, r in got.items()} == {("p_L1", 1), ("p_L2", 2), ("p_L3", 3), ("solo", 1), ("solo", 3)}
    assert got["p_L1_0002"].children == ["c2-0", "c2-1", "c2-2"] and (got["p_L1_0002"].first_page, got["p_L1_0002"].last_order) == (20, 202)
    assert got["p_L1_0002"].parent_id == "p_L2_0001" and got["p_L2_0001"].parent_id == "p_L3_0000" and got["p_L3_0000"].parent_id is None
    assert got["p_L1_0000"].n_siblings == 3 and got["p_L1_0000"].text.startswith("One 0. Three 0. ")
    assert got["solo_L3_0000"].children == ["solo_L1_0000"] and got["solo_L1_0000"].text.strip() == "A. B."
    assert trees.tree_nodes(spark.createDataFrame([], schema), work).count() == 0


def test_answers(spark):
    plans = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "query_id string, query_text string")
    contexts = spark.createDataFrame([("a", "k" * 3000), ("b", "short")], "query_id string, context string")
    plain = {r.query_id: r.answer for r in retrieval.answers(plans, contexts).collect()}
    assert plain == {"a": "k" * 2000, "b": "short", "c": retrieval.NO_CONTEXT}
    told = retrieval.answers(plans, contexts, lambda df: df.where("query_id = 'b'").select("query_id", F.upper("context").alias("answer")))
    assert {r.query_id: r.answer for r in told.collect()} == {**plain, "b": "SHORT"}


def test_totals_equal_the_deliveries(spark):
    e = spark.createDataFrame([(k, k % 3) for k in range(30)], "event_id long, event_type long")
    s = spark.createDataFrame([(u, u % 4) for u in range(10)], "subscriber long, event_type long")
    every = limits.fan_out(e, s).groupBy("subscriber").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event"))
    assert sorted(map(tuple, limits.fan_out_totals(e, s).collect())) == sorted(map(tuple, every.collect()))


def test_assembled_and_folded_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [(f"s{k % 3}" if k % 7 else None, k, f"i{k}", f"t{k} ") for k in range(25)]
        got = {r.session_id: (r.n_frames, r.text_hash) for r in limits.assembled(spark.createDataFrame(rows, "session_id string, created_at long, id string, content string")).collect()}
        for s in {r[0] for r in rows}:
            own = [r[3] for r in rows if r[0] == s]
            assert got[s] == (len(own), hashlib.md5("".join(own).encode()).hexdigest())
        sizes = [("p", 0, "a", 200), ("p", 1, "b", 150), ("p", 2, "c", 300), ("p", 3, "d", 10), ("q", 0, "e", 5)]
        df = spark.createDataFrame(sizes, "paper_id string, ord int, element_id string, n long")
        assert {tuple(r) for r in chunking.simple_fold(df).collect()} == {("p", 2, 10, 4), ("q", 0, 5, 1)}
        assert chunking.simple_fold(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_progress_and_providers(spark):
    df = spark.createDataFrame([("none", None, "GPT-4"), ("ready", None, "x/Groq"), ("failed", "parse", None), ("processing", "embed", "openrouter/gpt"), ("processing", None, "plain")], "s string, step string, model string")
    steps = (("queued", 0), ("parse", 20), ("embed", 60))
    got = df.select(text.progress(F.col("s"), F.col("step"), steps).alias("p"), text.provider(F.col("model")).alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [(0, "openai"), (100, "groq"), (100, "unknown"), (60, "openrouter"), (0, "unknown")]
