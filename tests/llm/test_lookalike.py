import unicodedata
from collections import Counter

from docspark.llm.lookalike import CLASS_OF, SCRIPTS, Resolver, bigram_counts, canonical_texts, compat, equal_looking_classes, equal_looking_pairs, script

CYR = str.maketrans("aeopcyxsij", "аеорсухѕіј")


def resolver():
    counts = Counter()
    for word in ("выборка", "граница", "сводка", "κέντρο", "the", "model", "capacity", "for"):
        bare = [c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)]
        counts.update(zip(["^", *bare], bare))
    return Resolver(counts)


def test_same_look_same_form():
    r = resolver()
    base = "The model for a capacity of 5 kΩ, naïve «выборка» é"
    for text in (
        base.translate(CYR),
        base.replace(" ", " "),
        base.replace("o", "​o").replace("m", "m­"),
        "Ｔｈｅ" + base[3:],
        unicodedata.normalize("NFD", base),
        base.replace("Ω", "Ω"),
        "﻿" + base.replace("e", "е"),
        base.replace("о", "o"),
    ):
        assert text != base and r.text(text) == r.text(base) == base


def test_visible_differences_stay():
    r = resolver()
    for a, b in (("x²", "x2"), ("A", "a"), ("é", "e"), ("a b", "ab"), ("a.", "a!"), ("naïve", "naive"), ("a  b", "a b"), ("½", "1/2"), ("a\nb", "a b")):
        assert r.text(a) != r.text(b)


def test_scripts_are_kept():
    r = resolver()
    for word in ("выборка", "κέντρο", "capacity"):
        assert r.text(word) == word
    assert r.text("сар") == r.text("cap") == "cap"


CORPUS = [
    *["росс орех сахар горох сорок выборка граница данные модель пехота орехи сахарный уходить"] * 20,
    *["the process of a model shows text and rows, because a casual spacer teaches search and places"] * 20,
    *["το κέντρο του κόσμου και η ροή"] * 5,
]


def counted(spark):
    rows = [(k, t) for k, t in enumerate(CORPUS)]
    return bigram_counts(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_scores_decide(spark):
    """Words that two scripts can spell: the bigrams and the letters around them choose the script, and an empty table chooses otherwise."""
    full, empty = Resolver(counted(spark)), Resolver({})
    assert full.text("орех и сахар, горох; сорок ухо") == "орех и сахар, горох; сорок ухо"
    assert full.text("opex и caxap, горох; copoк yxo") == "орех и сахар, горох; сорок ухо"
    assert full.text("a space of each case, model") == "a space of each case, model"
    words = ("oxo", "coc", "cace", "apex", "хоро", "ocox")
    assert any(full.text(w) != empty.text(w) for w in words)


def test_every_letter_of_a_class_has_a_script():
    for group in {CLASS_OF[c] for c in CLASS_OF}:
        assert all(script(c) < len(SCRIPTS) for c in group)
        assert len(set(group)) == len(group)


def test_classes(spark):
    rows = [(1, "the cat"), (2, "the саt"), (3, "the cat"), (4, "The cat"), (5, None), (1, "the cat")]
    out = equal_looking_classes(canonical_texts(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (4, 4, 1, 1)]


def test_form_depends_on_the_look_only():
    r = resolver()
    for word in ("сводка", "node", "рас", "κοσμος", "Тест", "ΑΒΓ"):
        forms = {word}
        for c in set(word) & set(CLASS_OF):
            forms |= {f.replace(c, other) for f in forms for other in CLASS_OF[c]}
        assert len({r.text(f) for f in forms}) == 1


def test_compat_is_idempotent():
    for t in ("ｆｕｌｌ　width", "é‍", "µm", "ﬁne", "‐‑", "a\tb\r\nc"):
        assert compat(compat(t)) == compat(t)


def test_operator(spark):
    long = "word " * 40_000
    rows = [(1, "the cat", "x"), (2, "the саt", "x"), (3, "the cat", "y"), (4, "The cat", None), (5, None, None), (6, "", None), (7, "​", None), (8, long, None), (9, long.replace("o", "о"), None), (2, "the саt", "x")]
    out = canonical_texts(spark.createDataFrame(rows, "doc_id bigint, text string, digest string"))
    assert out.count() == 9
    assert {tuple(r) for r in equal_looking_pairs(out).collect()} == {(1, 2), (2, 3), (6, 7), (8, 9)}


def test_empty(spark):
    out = canonical_texts(spark.createDataFrame([], "doc_id bigint, text string"))
    assert equal_looking_pairs(out).count() == 0
