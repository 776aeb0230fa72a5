import random

import numpy as np

from docspark.operators.components import connected_components, local_components


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_random_graph_and_path(spark, work):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)]
    df = spark.createDataFrame([*edges, edges[0], (5, None), (None, 6)], "a long, b long").repartition(4)
    got = {r.node: r.label for r in connected_components(df, work).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_empty(spark, work):
    assert connected_components(spark.createDataFrame([], "a string, b string"), work).count() == 0


def test_local():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 200, 90), rng.integers(0, 200, 90)
    want = brute(list(zip(a.tolist(), b.tolist())))
    got = local_components(200, a, b)
    assert all(got[x] == y for x, y in want.items())
