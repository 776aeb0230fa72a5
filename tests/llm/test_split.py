import random

from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm.split import boundaries, cut, split_oversized


def one_after_another(text, limit, overlap):
    """The same greedy cuts, found one by one."""
    if len(text) <= limit:
        return [(0, len(text))]
    at, rank, starts = boundaries(text, 50)
    ends = list(zip(at.tolist(), rank.tolist()))
    out, end = [], 0
    while end < len(text):
        begin = 0
        if end:
            back = max(end - overlap, 0)
            begin = next((int(s) for s in starts if back <= s < end), back)
        if begin + limit >= len(text):
            out.append((begin, len(text)))
            break
        for least, fill in ((3, limit // 2), (2, limit // 2), (1, 0), (0, 0)):
            # the farthest boundary of at least this rank, if it is full enough
            far = max((e for e, r in ends if r >= least and e <= begin + limit), default=0)
            if far > end and far >= begin + fill:
                break
        out.append((begin, far))
        end = far
    return out


def sound(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    whole = text[: pieces[0][1]]
    for (_, before), (s, e) in zip(pieces, pieces[1:]):
        assert s <= before < e and before - s <= overlap
        whole += text[before:e]
    assert whole == text and all(0 < e - s <= limit for s, e in pieces)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a ", "End. ", "Line\n", "para.\n\n", "x" * 40, " ", "ǘ ", "\r\n\r\n"]), max_size=300))
def test_cuts_equal_the_sequential_ones(parts):
    text = "".join(parts)
    pieces = cut(text, 120, 20)
    if text:
        sound(text, pieces, 120, 20)
        assert pieces == one_after_another(text, 120, 20)


def test_extremes():
    for text in ("x" * 50_000, " " * 9_000, "word. " * 30_000, "a" * 1999 + " " * 3000 + "b" * 2500, "w " * 1002):
        sound(text, cut(text, 2003, 200), 2003, 200)


def test_natural_boundaries_are_preferred():
    para = "Some words in a row. " * 60
    text = (para.strip() + "\n\n") * 4
    pieces = cut(text, 2003, 200)
    assert all(text[:e].rstrip().endswith(".") for _, e in pieces)
    assert text[: pieces[0][1]].endswith(para.strip())


def test_operator(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(2000))
    rows = [("t", "a", long, "x"), ("t", "a", long, "y"), ("t", "b", "short", "x"), ("t", "c", None, None), ("t", "d", "", None), (None, None, "z" * 2004, None), ("t", "e", "z" * 2003, None)]
    out = split_oversized(spark.createDataFrame(rows, "item_table string, item_id string, text string, start string")).collect()
    assert {r.item_id for r in out} == {"a", None}
    mine = sorted((r for r in out if r.item_id == "a"), key=lambda r: r.piece_no)
    assert [r.piece_no for r in mine] == list(range(mine[0].n_pieces))
    assert "".join(r.text[r.overlap :] for r in mine) == long
    assert all(r.token_count <= 500 for r in out)


def test_empty(spark):
    assert split_oversized(spark.createDataFrame([], "item_table string, item_id string, text string")).count() == 0


def test_a_paragraph_after_many_blanks_and_a_sentence_with_many_closers():
    text = "word" + " " * 5000 + "\n\n" + "next"
    at, rank, _ = boundaries(text)
    assert rank[at.tolist().index(4)] == 4
    text = "end." + "\"')]" * 10 + " next"
    at, rank, _ = boundaries(text)
    assert rank[at.tolist().index(44)] == 2


def test_an_id_with_two_texts(spark):
    rows = [("chunks", "a", "x " * 1500), ("chunks", "a", "y " * 1500), ("chunks", "a", "x " * 1500)]
    out = split_oversized(spark.createDataFrame(rows, "item_table string, item_id string, text string")).collect()
    texts = {}
    for r in out:
        texts.setdefault(r.digest, {})[r.piece_no] = r.text[r.overlap :]
    assert sorted("".join(p[k] for k in sorted(p)) for p in texts.values()) == ["x " * 1500, "y " * 1500]
