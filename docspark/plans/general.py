"""Queries of the general training-data operators (problems 2 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.hierarchy import descendants, hierarchy, links_of
from docspark.operators.orphans import orphan_references
from docspark.sources.tables import table
from docspark.work import Work


def _tree(spark: SparkSession, d: str) -> DataFrame:
    rows, work = table(spark, d, "chunks").select("chunk_id", "parent_ids", "children_ids"), Work(spark, "p2")
    return work.table(hierarchy(links_of(rows), work), "tree")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks on or below a circle of links, or more than 3 links below their root."""
    tree = _tree(spark, d)
    return tree.where("on_cycle or depth > 3").select(F.col("node").alias("chunk_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("hops"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with parent, root, depth, path and number of descendants."""
    tree = _tree(spark, d)
    below = descendants(tree).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return tree.join(below, "node", "left").select(
        F.col("node").alias("chunk_id"),
        F.col("parent").alias("parent_id"),
        F.col("root").alias("root_id"),
        F.col("depth").cast("long").alias("depth"),
        F.array_join("path", "/").alias("path"),
        F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"),
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with each of its descendants and their distance."""
    out = descendants(_tree(spark, d))
    return out.select("ancestor", F.col("node").alias("descendant"), F.col("distance").cast("long").alias("distance"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("chunk_id", "ingested_at", "children_ids", "summary_of", "sibling_ids")
    return orphan_references(rows, table(spark, d, "chunk_tombstones"), Work(spark, "p6"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References of chunks to chunks that are deleted, missing or stored in a later month."""
    return _orphans(spark, d).select("chunk_id", "ref_field", "ref_id", "kind")


def p6_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per field, month of the referring chunk, and kind."""
    y, m = F.floor(F.col("period") / 12), F.col("period") % 12 + 1
    month = F.when(F.col("period").isNotNull(), F.format_string("%04d-%02d", y, m)).otherwise("unknown")
    return _orphans(spark, d).groupBy("ref_field", month.alias("month"), "kind").agg(F.count("*").alias("n_refs"), F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("ref_id").alias("n_missing_keys"))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p6_found, p6_orphans_by_period)}

_P2 = """WITH RECURSIVE ids AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL),
pairs AS (SELECT unnest(parent_ids) AS p, chunk_id AS c FROM chunks UNION SELECT chunk_id, unnest(children_ids) FROM chunks),
links AS (SELECT c AS node, min(p) AS parent FROM pairs WHERE p IN (SELECT chunk_id FROM ids) AND c IN (SELECT chunk_id FROM ids) GROUP BY c),
tree AS (SELECT i.chunk_id AS node, l.parent FROM ids i LEFT JOIN links l ON l.node = i.chunk_id),
down AS (SELECT node, parent, node AS root, 0::BIGINT AS depth, node AS path FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.node, t.parent, d.root, d.depth + 1, d.path || '/' || t.node FROM down d JOIN tree t ON t.parent = d.node),
lost AS (SELECT node, parent FROM tree WHERE node NOT IN (SELECT node FROM down)),
climb AS (SELECT node, parent AS up FROM lost UNION SELECT c.node, l.parent FROM climb c JOIN lost l ON l.node = c.up),
ring AS (SELECT node FROM climb WHERE node = up),
rings AS (SELECT c.node, min(c.up) AS root FROM climb c WHERE c.up IN (SELECT node FROM ring) GROUP BY c.node)
"""
_P6 = """WITH ts AS (SELECT chunk_id, try_cast(ingested_at AS TIMESTAMPTZ) AS t, children_ids, summary_of, sibling_ids FROM chunks WHERE chunk_id IS NOT NULL),
seen AS (SELECT chunk_id, min(t) AS f, max(t) AS l FROM ts GROUP BY 1),
gone AS (SELECT t.chunk_id FROM chunk_tombstones t LEFT JOIN seen s ON s.chunk_id = t.chunk_id GROUP BY t.chunk_id HAVING NOT coalesce(bool_or(s.l >= t.deleted_at::TIMESTAMPTZ), false)),
refs AS (SELECT chunk_id, 'children_ids' AS ref_field, unnest(children_ids) AS ref_id FROM ts UNION SELECT chunk_id, 'summary_of', unnest(summary_of) FROM ts UNION SELECT chunk_id, 'sibling_ids', unnest(sibling_ids) FROM ts),
kinds AS (SELECT r.chunk_id, r.ref_field, r.ref_id, a.f, CASE WHEN r.ref_id IN (SELECT chunk_id FROM gone) THEN 'deleted' WHEN b.chunk_id IS NULL THEN 'missing'
  WHEN date_trunc('month', timezone('UTC', b.f)) > date_trunc('month', timezone('UTC', a.f)) THEN 'late' END AS kind
  FROM refs r JOIN seen a ON a.chunk_id = r.chunk_id LEFT JOIN seen b ON b.chunk_id = r.ref_id WHERE r.ref_id IS NOT NULL AND r.ref_id <> '')
"""
SQL = {
    "p2_found": _P2 + "SELECT node AS chunk_id, root AS root_id, depth::INT AS hops FROM down WHERE depth > 3 UNION ALL SELECT node, root, -1 FROM rings",
    "p2_hierarchy": _P2 + """, below AS (SELECT a AS node, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM down) GROUP BY a)
SELECT d.node AS chunk_id, d.parent AS parent_id, d.root AS root_id, d.depth, d.path, b.n::BIGINT AS n_descendants FROM down d JOIN below b ON b.node = d.node
UNION ALL SELECT l.node, l.parent, r.root, -1, NULL, 0 FROM lost l JOIN rings r ON r.node = l.node""",
    "p2_descendants": _P2 + """, up AS (SELECT node AS ancestor, node AS descendant, 0::BIGINT AS distance FROM down UNION ALL SELECT u.ancestor, t.node, u.distance + 1 FROM up u JOIN tree t ON t.parent = u.descendant)
SELECT ancestor, descendant, distance FROM up WHERE distance > 0""",
    "p6_found": _P6 + "SELECT chunk_id, ref_field, ref_id, kind FROM kinds WHERE kind IS NOT NULL",
    "p6_orphans_by_period": _P6 + """SELECT ref_field, coalesce(strftime(timezone('UTC', f), '%Y-%m'), 'unknown') AS month, kind, count(*) AS n_refs, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT ref_id) AS n_missing_keys
FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2, 3""",
}
