"""Queries over summary trees: grouping, nodes, links, integrity, fuzzy clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.text import count_tokens, extract_numbers, extractive_summary, normalize_title
from docspark.operators import knn, trees
from docspark.operators.retrieval import newest
from docspark.plans import registry
from docspark.plans.search import _CUR
from docspark.plans.textual import _ENDS, _title, _tokens
from docspark.sources.tables import table
from docspark.work import Work

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)
DIMS = 64


def current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return newest(table(spark, d, "chunks"), columns=("chunk_id", *columns))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d, "paper_id", "level", "section_hierarchy", "section_title", "order_range", "dense_vector").where("level = 0 and paper_id is not null")
    return c.withColumn("first_order", F.try_element_at("order_range", F.lit(1)))


@query("WITH " + _CUR + f""", s AS (SELECT paper_id, {_title("coalesce(section_hierarchy[1], section_title, 'unknown')")} AS section, chunk_id, coalesce(order_range[1], 0) AS o FROM cur WHERE level = 0 AND paper_id IS NOT NULL)
SELECT paper_id, section, count(*) AS n, string_agg(chunk_id, ',' ORDER BY o, chunk_id) AS chunk_ids FROM s GROUP BY 1, 2""")
def structural_groups(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of every paper by normalised top section, in reading order."""
    top = normalize_title(F.coalesce(F.try_element_at("section_hierarchy", F.lit(1)), F.col("section_title"), F.lit("unknown")))
    ids = F.array_sort(F.collect_list(F.struct(F.coalesce("first_order", F.lit(0)).alias("o"), "chunk_id")))
    return _leaves(spark, d).groupBy("paper_id", top.alias("section")).agg(F.count("*").alias("n"), F.array_join(F.transform(ids, lambda x: x["chunk_id"]), ",").alias("chunk_ids"))


@query("WITH " + _CUR + f""", s AS (SELECT paper_id, {_title("coalesce(section_hierarchy[1], section_title, 'unknown')")} AS section, coalesce({_title("section_hierarchy[2]")}, 'main') AS sub, chunk_id, coalesce(order_range[1], 0) AS o FROM cur WHERE level = 0 AND paper_id IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY paper_id, section) AS n, row_number() OVER (PARTITION BY paper_id, section ORDER BY o, chunk_id) AS r FROM s), k AS (SELECT paper_id, section, count(DISTINCT sub) AS k FROM s GROUP BY 1, 2)
SELECT n.paper_id, n.section, CASE WHEN k.k > 1 THEN n.sub ELSE 'half ' || CASE WHEN r <= n // 2 THEN 1 ELSE 2 END END AS part, count(*) AS n FROM n JOIN k ON k.paper_id = n.paper_id AND k.section = n.section WHERE n.n > 12 GROUP BY 1, 2, 3""")
def split_large_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sections of more than 12 chunks, by subsection or in halves."""
    from pyspark.sql.window import Window

    top = normalize_title(F.coalesce(F.try_element_at("section_hierarchy", F.lit(1)), F.col("section_title"), F.lit("unknown")))
    sub = F.coalesce(normalize_title(F.try_element_at("section_hierarchy", F.lit(2))), F.lit("main"))
    rows = _leaves(spark, d).select("paper_id", "chunk_id", top.alias("section"), sub.alias("sub"), F.coalesce("first_order", F.lit(0)).alias("o"))
    sizes = rows.groupBy("paper_id", "section").agg(F.count("*").alias("size"), F.count_distinct("sub").alias("k")).where("size > 12")
    r = F.row_number().over(Window.partitionBy("paper_id", "section").orderBy("o", "chunk_id"))
    part = F.when(F.col("k") > 1, F.col("sub")).when(F.col("r") <= F.floor(F.col("size") / 2), "half 1").otherwise("half 2")
    return rows.join(sizes, ["paper_id", "section"]).withColumn("r", r).groupBy("paper_id", "section", part.alias("part")).agg(F.count("*").alias("n"))


@query("WITH " + _CUR + f""", s AS (SELECT paper_id, chunk_id, coalesce(order_range[1], 0) AS o, coalesce({_title("coalesce(section_hierarchy[1], section_title, 'unknown')")}, 'unknown') AS section, coalesce({_title("section_hierarchy[2]")}, 'main') AS sub FROM cur WHERE level = 0 AND paper_id IS NOT NULL),
h AS (SELECT *, sum(n) OVER w AS held FROM (SELECT paper_id, section, count(*) AS n, min(o) AS first FROM s GROUP BY 1, 2) WINDOW w AS (PARTITION BY paper_id ORDER BY first, section ROWS UNBOUNDED PRECEDING)),
g AS (SELECT paper_id, section, sum(CASE WHEN held - n >= 3 AND n >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY first, section ROWS UNBOUNDED PRECEDING) AS grp, held - n >= 3 AND n < 3 AS appended FROM h),
l AS (SELECT s.*, g.grp, g.appended FROM s JOIN g ON g.paper_id = s.paper_id AND g.section = s.section), z AS (SELECT paper_id, grp, count(*) FILTER (WHERE NOT appended) AS n, count(DISTINCT sub) FILTER (WHERE NOT appended) AS k FROM l GROUP BY 1, 2),
q AS (SELECT l.*, CASE WHEN n <= 12 THEN 0 WHEN k > 1 THEN min(o) OVER (PARTITION BY l.paper_id, l.grp, appended, sub) WHEN row_number() OVER (PARTITION BY l.paper_id, l.grp, appended ORDER BY o, chunk_id) > n // 2 THEN 1 ELSE 0 END AS a, CASE WHEN n > 12 AND k > 1 THEN sub ELSE '' END AS b FROM l JOIN z ON z.paper_id = l.paper_id AND z.grp = l.grp),
t AS (SELECT paper_id, grp, max((a, b)) AS top FROM q WHERE NOT appended GROUP BY 1, 2), d AS (SELECT q.paper_id, chunk_id, dense_rank() OVER (PARTITION BY q.paper_id ORDER BY q.grp, CASE WHEN appended THEN top ELSE (a, b) END) - 1 AS cluster_no FROM q JOIN t ON t.paper_id = q.paper_id AND t.grp = q.grp)
SELECT *, count(*) OVER (PARTITION BY paper_id, cluster_no) AS n_in_cluster FROM d""")
def structural_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The structural cluster of every leaf."""
    return trees.structural_clusters(_leaves(spark, d))


_CLUSTER = """m AS (SELECT DISTINCT paper_id, cluster_id, unnest(chunk_ids) AS chunk_id FROM structural_clusters)"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structural_clusters").select("paper_id", "cluster_id", F.explode("chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()


@query("WITH " + _CUR + f""", {_CLUSTER} SELECT m.paper_id, m.cluster_id::BIGINT AS cluster_id, count(*) AS n_chunks, sum({_tokens('c.text_for_embedding')})::BIGINT AS tokens, md5(string_agg(CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN s[1] || '.' ELSE s[1] || '. ' || s[-1] || '.' END, ' ' ORDER BY c.chunk_id)) AS summary_hash
FROM m JOIN (SELECT *, {_ENDS.replace('string_split(text,', "string_split(coalesce(text_for_embedding, ''),")} AS s FROM cur) c ON c.chunk_id = m.chunk_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def section_summaries(spark: SparkSession, d: str) -> DataFrame:
    """First-level nodes: the extractive summary of every cluster of at least 3 chunks."""
    c = current(spark, d, "text_for_embedding")
    t = extractive_summary(F.array(F.coalesce("text_for_embedding", F.lit(""))))
    rows = _members(spark, d).join(c, "chunk_id").select("paper_id", "cluster_id", "chunk_id", t.alias("s"), count_tokens(F.col("text_for_embedding")).alias("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "s"))), lambda x: x["s"]), " ")
    return rows.groupBy("paper_id", "cluster_id").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("tokens"), F.md5(whole).alias("summary_hash")).where("n_chunks >= 3")


@query("WITH " + _CUR + """, l AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_sequence_index, chunk_id) AS r, count(*) OVER (PARTITION BY paper_id) AS n FROM cur WHERE level = 1 AND paper_id IS NOT NULL)
SELECT paper_id, chunk_id, n AS n_rows, floor((r - 1) / ceil(n / least(3, greatest(2, n // 3))))::BIGINT AS group_no FROM l WHERE n >= 2""")
def l2_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Second-level groups of the first-level nodes of every paper that has at least two."""
    l1 = current(spark, d, "paper_id", "level", "chunk_sequence_index").where("level = 1 and paper_id is not null")
    return trees.group_evenly(l1, "paper_id", ["chunk_sequence_index", "chunk_id"]).where("n_rows >= 2").select("paper_id", "chunk_id", "n_rows", "group_no")


@query("WITH " + _CUR + """ SELECT paper_id, count(*) AS n_sources, min(page_range[1])::BIGINT AS first_page, max(page_range[2])::BIGINT AS last_page, arg_min(order_range[1], (order_range[1], chunk_id))::BIGINT AS first_order, arg_max(order_range[2], (order_range[1], chunk_id))::BIGINT AS last_order, bool_or(coalesce(has_table, false)) AS has_table,
array_to_string(list_sort(list_distinct(flatten(list(coalesce(modalities, []))))), ',') AS modalities FROM cur WHERE level = 0 AND order_range IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1""")
def root_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What a root would take from its leaves: ranges in order, flags, and the sorted union of sets."""
    c = current(spark, d, "paper_id", "level", "order_range", "page_range", "has_table", "modalities").where("level = 0 and order_range is not null and paper_id is not null")
    at = F.struct(F.get("order_range", F.lit(0)).alias("o"), F.col("chunk_id"))
    kinds = c.select("paper_id", F.explode("modalities").alias("m")).where("m is not null").distinct().groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_list("m")), ",").alias("modalities"))
    out = c.groupBy("paper_id").agg(
        F.count("*").alias("n_sources"),
        F.min(F.try_element_at("page_range", F.lit(1))).alias("first_page"),
        F.max(F.try_element_at("page_range", F.lit(2))).alias("last_page"),
        F.min_by(F.get("order_range", F.lit(0)), at).alias("first_order"),
        F.max_by(F.try_element_at("order_range", F.lit(2)), at).alias("last_order"),
        F.bool_or(F.coalesce("has_table", F.lit(False))).alias("has_table"),
    )
    return out.join(kinds, "paper_id", "left").withColumn("modalities", F.coalesce("modalities", F.lit("")))


@query("WITH " + _CUR + f""", {_CLUSTER}, p AS (SELECT paper_id, chunk_id, unnest(map_entries(cluster_probabilities)) AS e FROM cur)
SELECT p.paper_id, p.chunk_id, e.key AS cluster, round(e.value, 6) AS score FROM p WHERE e.value >= 0.25 AND NOT EXISTS (SELECT 1 FROM m WHERE m.chunk_id = p.chunk_id AND m.paper_id = p.paper_id AND m.cluster_id::VARCHAR = e.key)""")
def cluster_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that belong by probability to clusters of their paper in which they are not listed."""
    p = current(spark, d, "paper_id", "cluster_probabilities").select("paper_id", "chunk_id", F.explode("cluster_probabilities").alias("cluster", "value")).where("value >= 0.25")
    home = _members(spark, d).select("paper_id", "chunk_id", F.col("cluster_id").cast("string").alias("cluster"))
    return p.join(home, ["paper_id", "chunk_id", "cluster"], "left_anti").select("paper_id", "chunk_id", "cluster", F.round("value", 6).alias("score"))


@query("WITH " + _CLUSTER + " SELECT a.paper_id, a.chunk_id, string_agg(DISTINCT b.chunk_id, ',' ORDER BY b.chunk_id) AS siblings FROM m a JOIN m b ON b.paper_id = a.paper_id AND b.cluster_id = a.cluster_id AND b.chunk_id <> a.chunk_id GROUP BY 1, 2")
def sibling_links(spark: SparkSession, d: str) -> DataFrame:
    """Siblings of a chunk: the other members of its clusters."""
    m = _members(spark, d)
    # one array a cluster; a chunk takes those of its clusters without itself, no pair is a row
    lists = m.groupBy("paper_id", "cluster_id").agg(F.collect_set("chunk_id").alias("all"))
    own = m.join(lists, ["paper_id", "cluster_id"]).groupBy("paper_id", "chunk_id").agg(F.flatten(F.collect_list("all")).alias("all"))
    others = F.array_remove(F.array_distinct("all"), F.col("chunk_id"))
    return own.select("paper_id", "chunk_id", others.alias("s")).where(F.size("s") > 0).select("paper_id", "chunk_id", F.array_join(F.sort_array("s"), ",").alias("siblings"))


@query("WITH " + _CUR + """, c AS (SELECT paper_id, level, count(*) AS n FROM cur WHERE paper_id IS NOT NULL GROUP BY 1, 2), k AS (SELECT paper_id, count(*) FILTER (WHERE len(list_distinct(chunk_ids)) >= 3) AS need1, count(*) AS k FROM (SELECT DISTINCT ON (paper_id, cluster_id) * FROM structural_clusters ORDER BY paper_id, cluster_id, len(list_distinct(chunk_ids)) DESC) GROUP BY 1),
s AS (SELECT k.paper_id, need1, least(3, greatest(2, k // 3)) AS need2, coalesce(sum(n) FILTER (WHERE level = 1), 0) AS l1, coalesce(sum(n) FILTER (WHERE level = 2), 0) AS l2, coalesce(sum(n) FILTER (WHERE level = 3), 0) AS l3 FROM k LEFT JOIN c ON c.paper_id = k.paper_id GROUP BY 1, 2, 3)
SELECT paper_id, l1 < need1 AS build_l1, l1 < need1 OR l2 < need2 AS build_l2, l1 < need1 OR l3 = 0 AS build_l3 FROM s""")
def build_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which levels of each paper's tree are to be built: an incomplete first level rebuilds all."""
    have = current(spark, d, "paper_id", "level").where("paper_id is not null").groupBy("paper_id").agg(*[F.count_if(F.col("level") == n).alias(f"l{n}") for n in (1, 2, 3)])
    sizes = table(spark, d, "structural_clusters").groupBy("paper_id", "cluster_id").agg(F.max(F.coalesce(F.size(F.array_distinct(F.filter("chunk_ids", lambda x: x.isNotNull()))), F.lit(0))).alias("n"))
    need = sizes.groupBy("paper_id").agg(F.count_if(F.col("n") >= 3).alias("need1"), F.count("*").alias("k")).withColumn("need2", F.least(F.lit(3), F.greatest(F.lit(2), F.floor(F.col("k") / 3))))
    s = need.join(have, "paper_id", "left").fillna(0, ["l1", "l2", "l3"])
    one = F.col("l1") < F.col("need1")
    return s.select("paper_id", one.alias("build_l1"), (one | (F.col("l2") < F.col("need2"))).alias("build_l2"), (one | (F.col("l3") == 0)).alias("build_l3"))


@query("WITH " + _CUR + ", e AS (SELECT DISTINCT chunk_id AS parent, unnest(children_ids) AS child FROM cur) SELECT paper_id, level::BIGINT AS level, count(*) AS n_nodes, sum(coalesce(d, 0))::BIGINT AS n_edges FROM cur LEFT JOIN (SELECT parent, count(*) AS d FROM e WHERE child <> '' GROUP BY 1) x ON x.parent = cur.chunk_id GROUP BY 1, 2")
def tree_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and outgoing edges of the trees by paper and level."""
    c = current(spark, d, "paper_id", "level", "children_ids")
    kids = F.coalesce(F.size(F.array_distinct(F.filter("children_ids", lambda x: x.isNotNull() & (x != "")))), F.lit(0))
    return c.groupBy("paper_id", "level").agg(F.count("*").alias("n_nodes"), F.sum(kids).alias("n_edges"))


@query("WITH " + _CUR + """, e AS (SELECT DISTINCT chunk_id AS id, unnest(children_ids) AS child FROM cur)
SELECT 'broken child link' AS problem, id, child AS other FROM e WHERE child <> '' AND child NOT IN (SELECT chunk_id FROM cur) UNION ALL SELECT 'orphan leaf', chunk_id, '' FROM cur WHERE level = 0 AND len(coalesce(parent_ids, [])) = 0""")
def tree_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Links to children that are not stored, and leaves without a parent."""
    c = current(spark, d, "level", "parent_ids", "children_ids")
    e = c.select(F.col("chunk_id").alias("id"), F.explode("children_ids").alias("chunk_id")).where("chunk_id <> ''").distinct()
    broken = e.join(c.select("chunk_id"), "chunk_id", "left_anti").select(F.lit("broken child link").alias("problem"), "id", F.col("chunk_id").alias("other"))
    orphans = c.where((F.col("level") == 0) & (F.coalesce(F.size("parent_ids"), F.lit(0)) <= 0)).select(F.lit("orphan leaf"), "chunk_id", F.lit(""))
    return broken.union(orphans)


@query("SELECT coalesce(paper_id, '(all)') AS paper_id, coalesce(level, -1)::BIGINT AS level, count(*) AS n, sum(token_count)::BIGINT AS tokens FROM chunks WHERE paper_id IS NOT NULL AND level IS NOT NULL GROUP BY ROLLUP (paper_id, level)")
def level_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("paper_id is not null and level is not null")
    return c.rollup("paper_id", "level").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens")).select(F.coalesce("paper_id", F.lit("(all)")).alias("paper_id"), F.coalesce("level", F.lit(-1)).alias("level"), "n", "tokens")


@query("SELECT paper_id, " + ", ".join(f"count(*) FILTER (WHERE level = {n}) AS l{n}" for n in range(4)) + ", count(*) FILTER (WHERE len(cluster_ids) > 1) AS n_multi_cluster FROM chunks GROUP BY 1")
def tree_state(spark: SparkSession, d: str) -> DataFrame:
    """Rows per level and rows in several clusters, per paper."""
    return table(spark, d, "chunks").groupBy("paper_id").agg(*[F.count_if(F.col("level") == n).alias(f"l{n}") for n in range(4)], F.count_if(F.size("cluster_ids") > 1).alias("n_multi_cluster"))


_NUM = r"list_distinct(regexp_extract_all({t}, '\b[0-9]+\.?[0-9]*\b'))"


@query("WITH " + _CUR + f""", src AS (SELECT s.chunk_id, any_value(s.text_for_embedding) AS summary, string_agg(c.text_for_embedding, chr(10) || chr(10) ORDER BY c.chunk_id) AS source FROM (SELECT DISTINCT chunk_id, text_for_embedding, unnest(children_ids) AS child FROM cur WHERE level >= 1) s JOIN cur c ON c.chunk_id = s.child WHERE c.text_for_embedding IS NOT NULL GROUP BY 1)
SELECT chunk_id, CASE WHEN summary IS NULL OR trim(summary) = '' THEN 'EMPTY_SUMMARY' WHEN {_tokens('source')} > 50 AND ({_tokens('summary')}) / greatest({_tokens('source')}, 1) > 0.6 THEN 'FAILED_COMPRESSION'
WHEN len(list_filter({_NUM.format(t='summary')}, lambda n: n::DOUBLE > 10 AND NOT list_contains({_NUM.format(t='source')}, n))) > 0 THEN 'FAILED_HALLUCINATION' ELSE 'PASSED' END AS verdict FROM src""")
def summary_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every summary held against its children's text: empty, too long, or with numbers that are not in the source."""
    return summaries_judged(spark, d).select("chunk_id", "verdict")


def summaries_judged(spark: SparkSession, d: str) -> DataFrame:
    """``(chunk_id, summary, source, verdict)`` of every stored summary."""
    c = current(spark, d, "level", "children_ids", "text_for_embedding")
    e = c.where("level >= 1").select(F.col("chunk_id").alias("id"), F.col("text_for_embedding").alias("summary"), F.explode(F.array_distinct("children_ids")).alias("chunk_id"))
    kids = e.join(c.where("text_for_embedding is not null").select("chunk_id", "text_for_embedding"), "chunk_id")
    parts = F.sort_array(F.collect_list(F.struct("chunk_id", "text_for_embedding")))
    src = kids.groupBy("id").agg(F.first("summary").alias("summary"), F.array_join(F.transform(parts, lambda x: x["text_for_embedding"]), "\n\n").alias("source"))
    new = F.filter(F.array_except(extract_numbers(F.col("summary")), extract_numbers(F.col("source"))), lambda n: n.cast("double") > 10)
    long = (count_tokens(F.col("source")) > 50) & (count_tokens(F.col("summary")) / F.greatest(count_tokens(F.col("source")), F.lit(1)) > 0.6)
    verdict = F.when(F.col("summary").isNull() | (F.trim("summary") == ""), "EMPTY_SUMMARY").when(long, "FAILED_COMPRESSION").when(F.size(new) > 0, "FAILED_HALLUCINATION").otherwise("PASSED")
    return src.select(F.col("id").alias("chunk_id"), "summary", "source", verdict.alias("verdict"))


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = current(spark, d, "paper_id", "level", "dense_vector").where((F.col("level") == 0) & (F.size("dense_vector") == DIMS)).select("paper_id", "chunk_id", F.col("dense_vector").alias("vector"))
    return x, _members(spark, d).groupBy("paper_id", "chunk_id").agg(F.min("cluster_id").alias("cluster"))


@query("WITH " + _CUR + f""", {_CLUSTER}, x AS (SELECT paper_id, chunk_id, dense_vector AS v FROM cur WHERE level = 0 AND len(dense_vector) = {DIMS}), st AS (SELECT paper_id, chunk_id, min(cluster_id) AS cluster FROM m WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT x.paper_id, x.chunk_id, st.cluster, unnest(v) AS val, generate_subscripts(v, 1) AS dim FROM x JOIN st ON st.paper_id = x.paper_id AND st.chunk_id = x.chunk_id),
c AS (SELECT paper_id, cluster, list(mean ORDER BY dim) AS c FROM (SELECT paper_id, cluster, dim, avg(val) AS mean FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
p AS (SELECT x.paper_id, x.chunk_id, c.cluster, 1 / pow(greatest(list_sum(list_transform(list_zip(v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 1e-10), 2) AS pull FROM x JOIN c ON c.paper_id = x.paper_id)
SELECT paper_id, chunk_id, cluster::BIGINT AS cluster, round(pull / sum(pull) OVER (PARTITION BY paper_id, chunk_id), 6) AS u FROM p""")
def fuzzy_one_step(spark: SparkSession, d: str) -> DataFrame:
    """Memberships after one step of fuzzy c-means from the structural clusters."""
    x, start = _points(spark, d)
    c = trees.centres(x.join(start, ["paper_id", "chunk_id"]).withColumn("one", F.lit(1.0)), "one", DIMS)
    return trees.memberships(x, c).select("paper_id", "chunk_id", "cluster", F.round("u", 6).alias("u"))


@query()
def fuzzy_memberships(spark: SparkSession, d: str) -> DataFrame:
    """The one or two clusters each leaf belongs to when the memberships have settled."""
    x, start = _points(spark, d)
    return trees.fuzzy_clusters(x, start, Work(spark, "fuzzy"), DIMS)


@query()
def semantic_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of a paper that say the same, resolved to the longest."""
    n = current(spark, d, "paper_id", "level", "dense_vector", "token_count", "children_ids").where("level >= 1")
    return trees.semantic_dedup(n.select("paper_id", "chunk_id", F.col("dense_vector").alias("vector"), "token_count", F.col("children_ids").alias("children")), Work(spark, "dedup"))


@query("WITH " + _CUR + f""", {_CLUSTER}, k AS (SELECT paper_id, count(DISTINCT cluster_id) AS k FROM m WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING k > 1)
SELECT c.paper_id, count(*) AS n_leaves, 0::BIGINT AS n_in_many, 0::BIGINT AS n_weak, 0::BIGINT AS n_foreign FROM cur c JOIN k ON k.paper_id = c.paper_id WHERE c.level = 0 AND len(c.dense_vector) = {DIMS} GROUP BY 1""")
def fuzzy_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the fuzzy memberships of every paper with several clusters: at most two a leaf, none below a quarter, none in another paper's cluster."""
    x, start = _points(spark, d)
    m = _members(spark, d)
    work = Work(spark, "fuzzy")
    u = work.table(trees.fuzzy_clusters(x, start, work, DIMS), "memberships")
    several = m.groupBy("paper_id").agg(F.count_distinct("cluster_id").alias("k")).where("k > 1").select("paper_id")
    leaves = x.join(several, "paper_id", "left_semi").groupBy("paper_id").agg(F.count("*").alias("n_leaves"))
    many = u.groupBy("paper_id", "chunk_id").agg(F.count("*").alias("n")).groupBy("paper_id").agg(F.count_if(F.col("n") > 2).alias("n_in_many"))
    own = m.select("paper_id", F.col("cluster_id").alias("cluster"), F.lit(True).alias("own")).distinct()
    bad = u.join(own, ["paper_id", "cluster"], "left").groupBy("paper_id").agg(F.count_if(F.col("score") < 0.25).alias("n_weak"), F.count_if(F.col("own").isNull()).alias("n_foreign"))
    return leaves.join(many, "paper_id", "left").join(bad, "paper_id", "left").fillna(0)


@query("WITH " + _CUR + f""", v AS (SELECT a.paper_id, a.chunk_id FROM cur a JOIN cur b ON a.paper_id = b.paper_id AND a.chunk_id <> b.chunk_id AND a.level >= 1 AND b.level >= 1 AND len(a.dense_vector) = len(b.dense_vector) WHERE round(list_cosine_similarity(a.dense_vector, b.dense_vector), 6) >= 0.9 AND NOT isnan(list_cosine_similarity(a.dense_vector, b.dense_vector)) GROUP BY 1, 2)
SELECT c.paper_id, count(*) AS n_nodes, count(v.chunk_id) AS n_resembling, 0::BIGINT AS n_chained, 0::BIGINT AS n_unlike_dropped FROM cur c LEFT JOIN v ON v.chunk_id = c.chunk_id WHERE c.level >= 1 GROUP BY 1""")
def dedup_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the deduplicated summaries of every paper: what a node is kept as stands for itself, and only nodes that resemble some other are dropped."""
    work = Work(spark, "dedup")
    n = work.table(current(spark, d, "paper_id", "level", "dense_vector", "token_count", "children_ids").where("level >= 1"), "summaries")
    named = n.select("paper_id", "chunk_id", F.col("dense_vector").alias("vector"), "token_count", F.col("children_ids").alias("children"))
    kept = work.table(trees.semantic_dedup(named, work), "kept")
    pairs = knn.similar_pairs(n.select(F.col("paper_id").alias("grp"), F.col("chunk_id").alias("id"), F.col("dense_vector").alias("vector")), 0.9)
    alike = pairs.select(F.col("a").alias("chunk_id")).union(pairs.select("b")).distinct().withColumn("alike", F.lit(True))
    ends = kept.where("chunk_id = kept_as").select(F.col("chunk_id").alias("kept_as"), F.lit(True).alias("end"))
    rows = n.select("paper_id", "chunk_id").join(kept.select("chunk_id", "kept_as"), "chunk_id", "left").join(ends, "kept_as", "left").join(alike, "chunk_id", "left")
    return rows.groupBy("paper_id").agg(F.count("*").alias("n_nodes"), F.count("alike").alias("n_resembling"), F.count_if(F.col("end").isNull()).alias("n_chained"), F.count_if((F.col("chunk_id") != F.col("kept_as")) & F.col("alike").isNull()).alias("n_unlike_dropped"))


@query()
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """Share of variance of the leading components of the stored vectors (all rows)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = current(spark, d, "dense_vector").where(F.size("dense_vector") == DIMS).select(array_to_vector("dense_vector").alias("v"))
    model = PCA(k=16, inputCol="v", outputCol="z").fit(v)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.explainedVariance)], "component int, share double")


@query("WITH " + _CUR + " SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.dense_vector, b.dense_vector), 6) AS similarity FROM cur a JOIN cur b ON a.paper_id = b.paper_id AND a.level = 1 AND b.level = 1 AND a.chunk_id < b.chunk_id WHERE round(list_cosine_similarity(a.dense_vector, b.dense_vector), 6) >= 0.9 AND NOT isnan(list_cosine_similarity(a.dense_vector, b.dense_vector))")
def summary_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of first-level summaries of a paper that resemble each other."""
    rows = current(spark, d, "paper_id", "level", "dense_vector").where("level = 1")
    return knn.similar_pairs(rows.select(F.col("paper_id").alias("grp"), F.col("chunk_id").alias("id"), F.col("dense_vector").alias("vector")), 0.9)
