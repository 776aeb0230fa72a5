import random

import pytest
from pyspark.sql import functions as F

from docspark.operators.hierarchy import descendants, hierarchy, links_of
from docspark.work import Work


def brute(parent: dict) -> dict:
    out = {}
    for n in parent:
        path, seen = [n], {n}
        while parent[path[-1]] is not None:
            p = parent[path[-1]]
            if p in seen:
                ring = path[path.index(p) :]
                out[n] = (min(ring), -1, None)
                break
            seen.add(p)
            path.append(p)
        else:
            out[n] = (path[-1], len(path) - 1, path[::-1])
    return out


def run(spark, work, parent: dict, paths: bool = True) -> dict:
    links = spark.createDataFrame(list(parent.items()), "node string, parent string")
    rows = hierarchy(links, work, paths).collect()
    assert len(rows) == len(parent)
    return {r.node: (r.root, r.depth, list(r.path) if paths and r.path is not None else None) for r in rows}


def test_random_forests_with_circles(spark, work):
    rng = random.Random(3)
    parent = {}
    for n in range(150):
        parent[f"t{n}"] = f"t{rng.randrange(n)}" if n and rng.random() < 0.9 else None
    for k, size in enumerate((1, 2, 3, 7, 20)):  # circles, each with a tail
        for i in range(size):
            parent[f"c{k}_{i:02d}"] = f"c{k}_{(i + 1) % size:02d}"
        parent[f"d{k}_0"], parent[f"d{k}_1"] = f"c{k}_00", f"d{k}_0"
    for i in range(70):  # a long chain
        parent[f"l{i:02d}"] = f"l{i - 1:02d}" if i else None
    assert run(spark, work, parent) == brute(parent)


class Counting(Work):
    """Counts rows and path entries of all intermediate tables."""

    rows = ids = 0

    def table(self, df, name):
        out = super().table(df, name)
        self.rows += out.count()
        if "path" in out.columns:
            self.ids += out.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.size(F.coalesce("path", F.array())))), F.lit(0))).first()[0]
        return out


@pytest.mark.parametrize("n", [300, 3000])
def test_many_small_circles_cost_rows_in_proportion(spark, n):
    work = Counting(spark, "circles")
    name = lambda c, k: F.concat(F.lit("c"), c.cast("string"), F.lit("_"), (k % 3).cast("string"))
    links = spark.range(n * 3).select(name(F.floor(F.col("id") / 3), F.col("id")).alias("node"), name(F.floor(F.col("id") / 3), F.col("id") + 1).alias("parent"))
    got = hierarchy(links, work).agg(F.count("*"), F.count_if("on_cycle"), F.count_distinct("root")).first()
    assert tuple(got) == (3 * n, 3 * n, n)
    assert work.rows < 60 * n and work.ids < 60 * n


def test_without_paths(spark, work):
    parent = {"a": None, "b": "a", "c": "b", "x": "x"}
    assert run(spark, work, parent, paths=False) == {"a": ("a", 0, None), "b": ("a", 1, None), "c": ("a", 2, None), "x": ("x", -1, None)}


def test_links_from_dirty_rows(spark):
    rows = spark.createDataFrame(
        [("a", None, ["b", "", None, "b"], 1), ("a", [], ["b"], 2), ("b", ["a", "nowhere"], None, 3), (None, ["a"], ["b"], 4), ("c", ["c"], [], 5)],
        "chunk_id string, parent_ids array<string>, children_ids array<string>, node int",
    )
    assert {(r.node, r.parent) for r in links_of(rows).collect()} == {("a", None), ("b", "a"), ("c", "c")}


def test_empty(spark, work):
    rows = spark.createDataFrame([], "chunk_id string, parent_ids array<string>, children_ids array<string>")
    tree = hierarchy(links_of(rows), work)
    assert tree.count() == 0
    assert descendants(tree).count() == 0


def test_descendants(spark, work):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, parent string")
    got = {(r.ancestor, r.node, r.distance) for r in descendants(hierarchy(links, work)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_hot_parent(spark, work):
    links = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("node"), F.when(F.col("id") > 0, F.lit("n0")).alias("parent"))
    got = hierarchy(links, work, paths=False).groupBy("root", "depth").count().collect()
    assert {(r.root, r.depth, r["count"]) for r in got} == {("n0", 0, 1), ("n0", 1, 2999)}
