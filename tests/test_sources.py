import json

import pytest
from pyspark.sql import functions as F

from docspark.operators.chunking import chunk_elements
from docspark.sources.documents import DocumentFormatError, elements_of, read_documents
from docspark.sources.store import ChunkStore, dump_json

SCHEMA = "chunk_id string, content_hash string, parent_ids array<string>, children_ids array<string>, paper_id string, level int"


def document(paper, n):
    return {
        "document": {"paper_id": paper, "paper_title": "T", "authors": ["A"], "language": "en"},
        "elements": [{"element_id": f"{paper}-{i}", "type": "text", "section": {"title": "3 Method", "hierarchy": ["3 Method"]}, "content": {"raw": "Some words here. " * 40}, "phase2_ready": {"action": "merge_with_adjacent_text"}} for i in range(n)],
    }


def test_read_directory_and_chunk(spark, tmp_path):
    for paper, n in (("p1", 4), ("p2", 2), ("p3", 0)):
        (tmp_path / paper).mkdir()
        (tmp_path / paper / "elements.json").write_text(json.dumps(document(paper, n)))
    (tmp_path / "other").mkdir()
    docs = read_documents(spark, str(tmp_path))
    assert {r.document.paper_id for r in docs.collect()} == {"p1", "p2", "p3"}
    rows = elements_of(docs)
    assert rows.count() == 6
    assert {r.paper_id for r in chunk_elements(rows).collect()} == {"p1", "p2"}


def test_bad_documents_fail(spark, tmp_path):
    with pytest.raises(DocumentFormatError):
        read_documents(spark, str(tmp_path / "nowhere"))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "elements.json").write_text('{"document": {"paper_id": "p"}, "elements": [{"type"')
    with pytest.raises(Exception):
        read_documents(spark, str(tmp_path)).collect()


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), SCHEMA)
    assert store.read().count() == 0
    rows = spark.createDataFrame([("a", "h1", None, None, "p/1", 0), ("b", "h2", [], None, "p/1", 0), ("s", "h3", [], ["a", "b"], "p/1", 1), ("c", "h1", [], None, "q", 0), ("d", "h1", [], None, "q", 0)], SCHEMA)
    assert store.upsert(rows, within=True) == 4
    assert store.upsert(rows) == 0
    assert {r.chunk_id for r in store.scan("p/1", [0]).collect()} == {"a", "b"}
    store.update_links(spark.createDataFrame([("a", ["s"], None), ("nobody", ["s"], None)], "chunk_id string, parent_ids array<string>, children_ids array<string>"))
    got = {r.chunk_id: (r.parent_ids, r.children_ids) for r in store.read().collect()}
    assert got["a"] == (["s"], None) and got["s"] == ([], ["a", "b"]) and len(got) == 4
    assert store.delete_levels(1) == 1
    assert {r.level for r in store.read().collect()} == {0}
    assert store.delete_papers(["p/1"]) == 1
    assert {r.paper_id for r in store.read().collect()} == {"q"}


def test_dump(spark, tmp_path):
    dump_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_sources_in_several_formats(spark, tmp_path):
    from docspark.sources.federated import read_sources

    spark.createDataFrame([("a", "d1", 2020, "x")], "paper_id string, doi string, year int, extra string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("b", None)], "paper_id string, doi string").write.json(f"{tmp_path}/j")
    spark.createDataFrame([("2021", "c")], "year string, paper_id string").write.option("header", True).csv(f"{tmp_path}/c")
    rows = read_sources(spark, {"one": ("parquet", f"{tmp_path}/p"), "two": ("json", f"{tmp_path}/j"), "three": ("csv", f"{tmp_path}/c")}, "paper_id string, doi string, year int")
    assert {tuple(r) for r in rows.collect()} == {("a", "d1", 2020, "one", 0), ("b", None, None, "two", 1), ("c", None, 2021, "three", 2)}
    assert read_sources(spark, {}, "paper_id string").count() == 0


def test_a_partition_of_the_store_is_written_as_one_file(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), SCHEMA)
    rows = spark.createDataFrame([(f"c{i}", f"h{i}", [], None, f"p{i % 3}", i % 2) for i in range(60)], SCHEMA).repartition(4)
    assert store.upsert(rows) == 60
    assert len(list((tmp_path / "store").glob("*/*/*.parquet"))) == 6
    store.update_links(rows.select("chunk_id", F.array(F.lit("up")).alias("parent_ids")))
    assert len(list((tmp_path / "store").glob("*/*/*.parquet"))) == 6 and store.read().where("parent_ids[0] = 'up'").count() == 60
