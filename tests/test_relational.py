from datetime import datetime

import duckdb

from docspark.operators import relational as rel
from docspark.plans import library

USERS = [("s1", "u1", "p1", "Graph Kinds of a Layer"), ("s2", "u1", "p2", "graph"), ("s3", "u2", "p3", "graph"), ("s4", "u1", "p1", None), ("s5", "u1", "p1", "graph of nothing")]
PAPERS = [("p1", "On trees", ["Ann"], "u1"), ("p2", "A layer: kinds of graph", ["Ann"], None), ("p3", "GRAPH", [], "u2"), ("p4", "Layer of", ["Graph Kinds", "A"], "u1"), ("p5", "a layer of graph kinds", [], "u3")]


def test_contains_all_words_in_own_library(spark):
    searches = spark.createDataFrame([(i, u, t) for i, u, _, t in USERS], "id string, user_id string, text string")
    texts = {p: " ".join([t, *a]) for p, t, a, _ in PAPERS}
    own = {(u, p) for _, u, p, _ in USERS} | {(u, p) for p, _, _, u in PAPERS if u}
    held = spark.createDataFrame([(u, p, texts[p]) for u, p in sorted(own)], "user_id string, paper_id string, text string")
    got = sorted(tuple(r) for r in rel.contains_all(searches, held).collect())
    # the session's own paper p1 has none of the words; p2 and p4 are elsewhere in the library, p5 in that of another user
    assert got == [("s1", "p2"), ("s1", "p4"), ("s2", "p2"), ("s2", "p4"), ("s3", "p3")]


def test_fulltext_library_reaches_every_paper_of_the_user(spark, tmp_path):
    papers = [{"paper_id": p, "title": t, "authors": [{"name": n, "affiliation": "x"} for n in a] or [{"name": None, "affiliation": "x"}], "year": 2000, "rag_status": "ready", "uploaded_by": u} for p, t, a, u in PAPERS]
    sessions = [{"id": i, "user_id": u, "paper_id": p, "rolling_summary": t, "last_message_at": datetime(2024, 1, 1)} for i, u, p, t in USERS]
    for name, df in (("papers", papers), ("chat_sessions", sessions)):
        spark.createDataFrame(df, {"papers": "paper_id string, title string, authors array<struct<name string, affiliation string>>, year int, rag_status string, uploaded_by string", "chat_sessions": "id string, user_id string, paper_id string, rolling_summary string, last_message_at timestamp"}[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted(tuple(r) for r in library.QUERIES["fulltext_library"](spark, str(tmp_path)).collect())
    assert got == [("s1", "p2"), ("s1", "p4"), ("s2", "p2"), ("s2", "p4"), ("s3", "p3")]
    con = duckdb.connect()
    for name in ("papers", "chat_sessions"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(library.SQL["fulltext_library"]).fetchall()) == got


def test_texts_are_cut_into_words_before_they_meet_their_holders(spark):
    searches = spark.createDataFrame([(1, "u", "Graph learning"), (2, "v", "graph"), (3, "u", "x"), (4, "u", None)], "id int, user_id string, text string")
    held = spark.createDataFrame([("u", "p"), ("v", "p"), ("u", "q")], "user_id string, paper_id string")
    texts = spark.createDataFrame([("p", "A graph"), ("p", "on Learning, graph"), ("p", None), ("q", "graph"), ("r", "graph learning x")], "paper_id string, text string")
    out = rel.contains_all_within(searches, held, texts)
    assert sorted(map(tuple, out.collect())) == [(1, "p"), (2, "p")]


def test_full_text_search_never_puts_a_papers_abstract_together(spark):
    plan = library.QUERIES["fulltext_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
