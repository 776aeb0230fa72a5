import random

from docspark.operators.chunking import BOUNDARY, LEAST, MERGED, MOST, Machine, chunk_elements, cut_at, prepared, tokens

SCHEMA = """element_id string, paper_id string, type string, location struct<page_no:int,order:int>, section struct<title:string,hierarchy:array<string>>,
content struct<raw:string,token_count:int,caption:string,header_row:array<string>,rows:array<map<string,string>>>, phase2_ready struct<action:string,text_for_embedding:string>, parsed_at timestamp"""
SENTENCE = "The model maps every token to a vector of fixed size. "


def element(n, text, kind="text", action=MERGED[0], title="3 Method", paper="p", header=None, rows=None):
    return (f"{paper}-{n}", paper, kind, (1, n), (title, [title]), (text, None, "Caption", header, rows), (action, None), None)


def run(spark, rows):
    out = chunk_elements(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(out, key=lambda r: (r.paper_id, r.seq))


def test_skips_references_and_cuts_long_text(spark):
    rows = [
        element(0, "3 Method", "section_header", BOUNDARY),
        element(1, SENTENCE * 60),
        element(2, "[1] Someone. A title.", title="References"),
        element(3, SENTENCE * 12, title="4 Results"),
    ]
    out = run(spark, rows)
    assert all(tokens(r.text) == r.token_count for r in out)
    assert all(r.token_count <= MOST + 50 for r in out)
    assert not any("Someone" in r.text for r in out)
    assert "".join("".join(r.text for r in out).split()) == "".join((SENTENCE * 72).split())


def test_small_tail_is_kept(spark):
    out = run(spark, [element(0, "h", "section_header", BOUNDARY), element(1, SENTENCE * 25), element(2, "A short last remark.")])
    assert out[-1].text.endswith("A short last remark.")


def test_atomic_stays_whole(spark):
    big = "1|2|3\n" * 500
    out = run(spark, [element(0, "h", "section_header", BOUNDARY), element(1, SENTENCE * 10), element(2, big, "table", "self_contained_chunk"), element(3, SENTENCE * 10)])
    assert any(r.text == big.strip() for r in out)


def test_misaligned_table(spark):
    out = run(spark, [element(0, "h", "section_header", BOUNDARY), element(1, "cells", "table", "self_contained_chunk", header=["N", "d"], rows=[{"N": "base", "d": "5"}])])
    assert out[0].text == "Caption\n\nColumns: N | d"


def test_no_header_gets_parts(spark):
    out = run(spark, [element(n, SENTENCE * 20, title="x") for n in range(6)])
    assert {r.section_title for r in out} >= {"part_1", "part_2"}


def test_parts_count_from_zero_again(spark):
    sizes = {"p": [390, 390, 390, 390], "q": [1000, 10, 390, 5], "h": [390, 390, 390]}
    rows = [element(n, "abc " * k, paper=p) for p, ks in sizes.items() for n, k in enumerate(ks)]
    rows.append(element(9, "Head", kind="section_header", paper="h"))
    got = {r.element_id: r.title for r in prepared(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[f"p-{n}"] for n in range(4)] == ["part_1", "part_1", "part_2", "part_2"]
    assert [got[f"q-{n}"] for n in range(4)] == ["part_1", "part_2", "part_2", "part_3"]
    assert {got[f"h-{n}"] for n in (0, 1, 2, 9)} == {"3 Method"}


def test_empty(spark):
    assert run(spark, []) == []


def test_machine_loses_nothing():
    rng = random.Random(2)
    for _ in range(60):
        m, given = Machine("p"), []
        kinds = [(rng.choice([*MERGED, "self_contained_chunk", BOUNDARY, "?"]), rng.choice(["text", "table"])) for _ in range(25)]
        for n, (action, kind) in enumerate(kinds):
            text = SENTENCE * rng.choice([0, 1, 3, 9, 14, 60])
            nxt = kinds[n + 1][0] if n + 1 < len(kinds) else None
            m.element((f"e{n}", "t", n, kind), action, text, nxt)
            if action != BOUNDARY:
                given.append(text)
        m.finish()
        out = m.take()
        assert "".join("".join(r[9] for r in out).split()) == "".join("".join(given).split())
        assert [r[1] for r in out] == list(range(len(out)))
        assert all(r[6] >= LEAST for r in out[:-1] if not r[5])


def test_cut_at():
    assert cut_at("x" * 5000) == 1200
    assert cut_at("short") == 5
    t = SENTENCE * 60
    assert t[: cut_at(t)].endswith(".") and cut_at(t) <= 1350
