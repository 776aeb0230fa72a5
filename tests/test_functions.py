import pytest
from pyspark.sql import functions as F

from docspark.functions import sections, signals, text, vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_token_count(spark):
    assert one(spark, text.count_tokens(F.col("t")), t="a sentence of words") == 4
    assert one(spark, text.count_tokens(F.col("t")), t="") == 0
    assert one(spark, text.count_tokens(F.col("t")), t="ab") == 1
    assert one(spark, text.count_tokens(F.lit(None).cast("string"))) == 0


def test_clean_and_numbers(spark):
    assert one(spark, text.clean_text(F.col("t")), t="  a   b\n\n\n\nc\x07 ") == "a b\n\nc"
    assert set(one(spark, text.extract_numbers(F.col("t")), t="28.4 with 6 heads and 6")) == {"28.4", "6"}


@pytest.mark.parametrize("title, want", [("6.2 Model Variations", "model variations"), ("3. Methods", "methods"), ("Abstract", "abstract"), ("3D Vision", "d vision")])
def test_title(spark, title, want):
    assert one(spark, text.normalize_title(F.col("t")), t=title) == want


def test_sentence_boundary(spark):
    t = "One short one. Two short two. Three is here. Four is here. Five ends it."
    assert 0 < one(spark, text.sentence_boundary(F.col("t"), 10), t=t) <= len(t)
    assert one(spark, text.sentence_boundary(F.col("t"), 1000), t=t) == len(t)
    assert one(spark, text.sentence_boundary(F.col("t"), 10), t="x" * 5000) == -1


def test_pack_paragraphs(spark):
    t = "\n\n".join(["A sentence of some words here. Another one follows it now."] * 6)
    parts = one(spark, text.pack_paragraphs(F.col("t"), 30), t=t)
    assert len(parts) > 1 and all(len(p) // 4 <= 30 for p in parts)
    assert "".join("".join(parts).split()) == "".join(t.split())


def test_cursor_round_trip(spark):
    c = text.encode_cursor(F.lit(17), F.lit("id|7"))
    assert tuple(one(spark, text.decode_cursor(c))) == ("17|id", "7")


@pytest.mark.parametrize(
    "title, raw, want",
    [("References", "x", "metadata_only"), ("Acknowledgements", "x", "skip"), ("Abstract", "x", "process_high"), ("6.2 Model Variations", "x", "process_high"), ("Conclusion", "Acknowledgements we thank", "skip"), ("Appendix", "x", "process_medium"), (None, None, "process_medium")],
)
def test_treatment(spark, title, raw, want):
    assert one(spark, sections.treatment(F.lit(title).cast("string"), F.lit(raw).cast("string"), F.lit(4))) == want


def test_boost(spark):
    assert one(spark, sections.boost(F.lit("process_high"))) == 1.10
    assert one(spark, sections.boost(F.lit("skip"))) == 0.0


@pytest.mark.parametrize(
    "q, want",
    [("what BLEU score did the transformer achieve on WMT 2014", "A"), ("how many attention heads does the base model use", "C"), ("explain the main contribution of this paper", "B"), ("show me the attention formula", "D"), ("what does Table 2 show", "D"), ("summarize the paper", "B")],
)
def test_route(spark, q, want):
    df = spark.range(1).select(*[c.alias(n) for n, c in signals.signals(F.lit(q)).items()])
    assert df.select(signals.mode().alias("m")).first().m == want


def test_list_sizes():
    assert (len(signals.SPECIFIC) + 1, len(signals.BROAD) + signals.EMPTY_BROAD, len(signals.TABLE), len(signals.EQUATION), len(signals.FIGURE), len(signals.CROSS_SECTION)) == (53, 42, 13, 13, 11, 16)


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vectors.cosine(v(1, 0, 0), v(1, 0, 0))) == 1
    assert one(spark, vectors.cosine(v(1, 0, 0), v(0, 1, 0))) == 0
    assert one(spark, vectors.cosine(v(0, 0), v(0, 1))) == 0
    assert one(spark, vectors.sparse_dot(F.array(F.lit(1), F.lit(2)), v(1, 2), F.array(F.lit(2), F.lit(3)), v(5, 7))) == 10
    assert one(spark, vectors.truncate(v(3, 4, 9), 2)) == [0.6, 0.8]
