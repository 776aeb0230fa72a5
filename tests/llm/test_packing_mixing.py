import random

import pytest

from docspark.llm.mixing import mix
from docspark.llm.packing import best_fit, fill_report, improve, pack
from docspark.llm.tokens import token_sizes

ITEMS = "doc_id bigint, tokens bigint, part string, profile string"
PROFILES = "profile string, capacity_tokens int"


def test_search_keeps_items_and_capacity():
    rng = random.Random(1)
    for _ in range(40):
        cap = rng.choice([20, 100, 512])
        sizes = [rng.randint(1, cap) for _ in range(rng.randrange(1, 80))]
        before = best_fit(sizes, cap)
        fills = [sum(sizes[i] for i in b) for b in before]
        after = improve(sizes, [list(b) for b in before], cap)
        assert sorted(i for b in after for i in b) == list(range(len(sizes)))
        assert all(0 < sum(sizes[i] for i in b) <= cap for b in after)
        assert len(after) <= len(before)
        assert sum(sum(sizes[i] for i in b) ** 2 for b in after) >= sum(f * f for f in fills)


def test_search_empties_a_container():
    # best fit leaves 6+3, 5+3, 2; exchanges close two containers of 10 exactly when they can
    sizes = [6, 5, 4, 3, 2]
    bins = [[0, 3], [1, 2], [4]]
    after = improve(sizes, bins, 10)
    assert len(after) == 2 and sorted(sum(sizes[i] for i in b) for b in after) == [10, 10]


def test_pack(spark, work):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randint(1, 60), rng.randint(60, 300)]), "p", "q") for i in range(700)] + [(700, 1000, "p", "q"), (701, 0, "p", "q"), (None, 5, "p", "q"), (702, None, "p", "q"), (5, 1, "p", "q"), (703, 256, "p", "q")]
    profiles = spark.createDataFrame([("small", 128), ("large", 256), ("none", None), (None, 5), ("zero", 0)], PROFILES)
    out = work.table(pack(spark.createDataFrame(rows, ITEMS), profiles, work, block_items=150), "out")
    sizes = {}
    for i, t, *_ in rows:
        if i is not None and t:
            sizes[i] = max(t, sizes.get(i, 0))
    for profile, cap in (("small", 128), ("large", 256)):
        mine = out.where(f"profile = '{profile}'").collect()
        total, fill = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            assert sizes[r.doc_id] > cap or r.part == 0
        assert total == sizes
        assert max(fill.values()) <= cap
    report = {r.profile: r for r in fill_report(out).collect()}
    assert set(report) == {"small", "large"} and all(r.fill > 0.97 for r in report.values())


def test_pack_empty(spark, work):
    assert pack(spark.createDataFrame([], ITEMS), spark.createDataFrame([("a", 5)], PROFILES), work).count() == 0
    assert pack(spark.createDataFrame([(1, 5, "", "")], ITEMS), spark.createDataFrame([], PROFILES), work).count() == 0


def mixed(spark, work, docs, targets, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint, key string, range int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, report = mix(d, t, work, **options)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_mix(spark, work):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 8 + ["small", "mid"]), rng.randint(1, 50), "k", 1) for i in range(2000)] + [(9000, None, 5, "k", 1), (9001, "unlisted", 5, "k", 1), (9002, "big", 0, "k", 1), (9003, "big", None, "k", 1)]
    chosen, report = mixed(spark, work, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("mid", 0.1, 2), ("absent", 0.1, 3)])
    stock = {}
    for i, s, t, *_ in docs:
        if s and t:
            stock[s] = stock.get(s, 0) + t
    caps = {"big": 1, "small": 4, "mid": 2}
    assert all(1 <= r.repeats <= caps[r.source] for r in chosen)
    for s, share in (("big", 0.5), ("small", 0.3), ("mid", 0.1)):
        used = sum(r.tokens * r.repeats for r in chosen if r.source == s)
        assert used == report[s].used_tokens and report[s].available_tokens == stock[s]
        assert abs(report[s].actual_share - share / 0.9) < 0.01
    assert report["absent"].used_tokens == 0 and report["absent"].n_documents == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5


def test_mix_with_a_total(spark, work):
    docs = [(i, "ab"[i % 2], 10, "k", 1) for i in range(200)]
    _, report = mixed(spark, work, docs, [("a", 0.75, 2), ("b", 0.25, 1)], total=400)
    assert report["a"].used_tokens == 300 and report["b"].used_tokens == 100


def test_mix_empty(spark, work):
    chosen, report = mixed(spark, work, [], [("a", 1.0, 1)])
    assert chosen == [] and report["a"].actual_share == 0
    chosen, report = mixed(spark, work, [(1, "a", 5, "k", 1)], [])
    assert chosen == [] and report == {}


def test_token_sizes(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, "s", "Hello world, hello."), (2, None, None), (3, "s", ""), (4, "s", "<|endoftext|>"), (5, "s", "word " * 30_000)]
    out = {r.doc_id: r.tokens for r in token_sizes(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert out[2] == out[3] == 0 and 0 < out[1] < 10 and out[4] > 1 and out[5] >= 30_000
