"""Parent-child links to full hierarchies by hash splitters.

Every node whose hash falls on a residue is a *splitter*. All nodes walk up to
their next splitter or root (a walk that doubles its stride each round and is
absorbed there); the splitters' walks form a reduced pointer graph, which is
solved by the same doubling; root, depth and path of a node are then its own walk
followed by its splitter's. The smallest node of a circle meets itself as soon as a stride
is as long as the circle; it names the circle, and everything whose walk has led there leaves the
walk at once: in the full graph that is a splitterless circle and what hangs below it, in the reduced
graph a circle that has splitters. So what a circle costs depends on its length and not on how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.work import Work

#: One node in so many is a splitter.
SPLIT_EVERY = 4


def links_of(rows: DataFrame, node: str = "chunk_id", parents: str = "parent_ids", children: str = "children_ids") -> DataFrame:
    """``(node, parent)``, one row per node that has a row; parent null for a root.

    A link may be stored at either end. Null ids, empty strings, and ids without a
    row are ignored, repeated links and repeated rows count once; of several
    parents (not in valid data) the smallest id is taken.
    """
    nodes = rows.select(F.col(node).alias("node")).where("node is not null").distinct()
    up = rows.select(F.explode(parents).alias("parent"), F.col(node).alias("child"))
    down = rows.select(F.col(node).alias("parent"), F.explode(children).alias("child"))
    pairs = up.union(down).where("parent is not null and child is not null and parent <> ''").distinct()
    known = pairs.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")
    one = known.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    return nodes.join(one, "node", "left").select("node", "parent")


def _is_splitter(c: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("splitter"), F.col(c)), F.lit(SPLIT_EVERY)) == 0


def _double(start: DataFrame, work: Work, paths: bool, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Doubles the written table ``(node, ptr, hops, mark, low, stop[, path])`` until every pointer stands on a stop or is known to circle.

    ``mark`` is the smallest of the nodes met that have a row here (the node itself excluded, ptr included), ``low`` that of all
    nodes passed, ``path`` the ids passed from below ptr down to the node. Returns the absorbed parts and ``(node, root)`` of
    what is on a circle or below one, root being the circle's smallest id (None if there is no circle).
    """
    columns = ["node", "ptr", "hops", "mark", "low"] + ["path"] * paths
    absorbed: list[DataFrame] = [start.where("stop").select(*columns)]
    active = start.where("not stop").select(*columns)
    lost: list[DataFrame] = []
    while True:
        n, met = active.agg(F.count("*"), F.count_if(F.col("mark") == F.col("node"))).first()
        if met:
            rings = active.where("mark = node").select("mark", F.col("low").alias("root"))
            lost.append(work.table(active.join(rings, "mark").select("node", "root"), name))
            before, active = active, work.table(active.join(lost[-1], "node", "left_anti"), name)
            work.drop(before)
        if not n:
            break
        # what a pointer may meet: rows still walking, rows absorbed in an earlier round, and circles
        known = active.withColumn("stop", F.lit(False))
        for part in absorbed:
            known = known.unionByName(part.withColumn("stop", F.lit(True)))
        known = known.withColumn("root", F.lit(None).cast(start.schema["node"].dataType))
        for part in lost:
            known = known.unionByName(part, allowMissingColumns=True)
        k = known.select(F.col("node").alias("ptr"), *[F.col(c).alias(f"k_{c}") for c in columns[1:]], "stop", "root")
        step = active.join(k, "ptr").select(
            "node",
            F.col("k_ptr").alias("ptr"),
            (F.col("hops") + F.col("k_hops")).alias("hops"),
            F.least("mark", "k_mark").alias("mark"),
            F.least("low", "k_low").alias("low"),
            *[F.when(F.col("root").isNull(), F.concat("k_path", "path")).alias("path")] * paths,
            "stop",
            "root",
        )
        step = work.table(step, name)
        absorbed.append(step.where("stop").select(*columns))
        lost.append(step.where("root is not null").select("node", "root"))
        before, active = active, step.where("not stop").select(*columns)
        work.drop(before)
    circles = None
    for part in lost:
        circles = part if circles is None else circles.unionByName(part)
    return absorbed, circles


def hierarchy(links: DataFrame, work: Work, paths: bool = True) -> DataFrame:
    """``links(node, parent)`` -> ``(node, parent, root, depth, on_cycle[, path])``.

    ``path`` lists the ids from the root down to the node, both included. A node on a
    circle or below one has depth -1, the circle's smallest id as root, a null path, and
    ``on_cycle`` true. A node may be its own parent. An empty table gives an empty result.
    """
    base = work.table(links, "links")
    roots = base.where("parent is null").select("node")
    walk = base.where("parent is not null").select("node", F.col("parent").alias("ptr"))
    ends = roots.select(F.col("node").alias("ptr"), F.lit(True).alias("end"))
    start = walk.join(ends, "ptr", "left").select(
        "node",
        "ptr",
        F.lit(1).cast("long").alias("hops"),
        F.col("ptr").alias("mark"),
        F.col("ptr").alias("low"),
        *[F.array("node").alias("path")] * paths,
        (F.coalesce("end", F.lit(False)) | _is_splitter("ptr")).alias("stop"),
    )
    walked, loose = _double(work.table(start, "walk"), work, paths, "walk")
    own = walked[0]
    for part in walked[1:]:
        own = own.unionByName(part)

    # the reduced graph: only splitters that are not roots, each pointing at its next stop
    reduced = own.where(_is_splitter("node")).join(ends, "ptr", "left").withColumn("end", F.coalesce("end", F.lit(False)))
    if loose is not None:  # a splitter below a splitterless circle cannot be walked on to an end; it is one
        reduced = reduced.join(loose.select(F.col("node").alias("ptr"), F.lit(True).alias("lost")), "ptr", "left").withColumn("end", F.col("end") | F.coalesce("lost", F.lit(False))).drop("lost")
    reduced = work.table(reduced.withColumn("mark", F.col("ptr")).withColumnRenamed("end", "stop"), "reduced")
    solved, rings = _double(reduced, work, paths, "reduced")
    top = solved[0]
    for part in solved[1:]:
        top = top.unionByName(part)

    blank = F.lit(None).cast("array<string>")
    columns = ["node", "root", "depth"] + ["path"] * paths
    # where each stop leads: a root leads to itself
    ends_at = roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *[F.array("node").alias("path")] * paths)
    named = top.select("node", F.col("ptr").alias("root"), F.col("hops").alias("depth"), *[F.concat(F.array("ptr"), "path").alias("path")] * paths)
    circles = None
    for part in (loose, rings):
        if part is not None:
            named_part = part.select("node", "root", F.lit(-1).cast("long").alias("depth"), *[blank.alias("path")] * paths)
            circles = named_part if circles is None else circles.unionByName(named_part)
    if circles is not None:
        circles = work.table(circles, "circles")
        lost = circles.select(F.col("node").alias("root"), F.col("root").alias("ring"))
        named = named.join(lost, "root", "left").select(
            "node",
            F.coalesce("ring", "root").alias("root"),
            F.when(F.col("ring").isNull(), F.col("depth")).otherwise(F.lit(-1)).alias("depth"),
            *[F.when(F.col("ring").isNull(), F.col("path")).alias("path")] * paths,
        )
        stops = ends_at.unionByName(named).unionByName(circles)
    else:
        stops = ends_at.unionByName(named)
    s = stops.select(F.col("node").alias("ptr"), "root", F.col("depth").alias("s_depth"), *[F.col("path").alias("s_path")] * paths)
    below = own.join(s, "ptr").select(
        "node",
        "root",
        F.when(F.col("s_depth") < 0, F.lit(-1)).otherwise(F.col("s_depth") + F.col("hops")).alias("depth"),
        *[F.when(F.col("s_depth") >= 0, F.concat("s_path", "path")).alias("path")] * paths,
    )
    found = ends_at.unionByName(below)
    if loose is not None:
        found = found.unionByName(circles.join(loose.select("node"), "node", "left_semi").select(*columns))
    found = found.withColumn("on_cycle", F.col("depth") < 0)
    return found.join(base, "node").select("node", "parent", "root", "depth", "on_cycle", *["path"] * paths)


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor, node, distance)`` for every node and each ancestor on its path; nodes of circles have none."""
    up = tree.where("path is not null").select("node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where("at < depth").select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
