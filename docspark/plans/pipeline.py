"""Queries of the ingestion and summary pipeline as a whole: encoders, nodes, links, status, reports, purges, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import text
from docspark.operators import encode, trees
from docspark.plans import registry
from docspark.plans.search import _CUR
from docspark.plans.textual import _ENDS, _strip, _tokens
from docspark.plans.trees import _CLUSTER, _NUM, _members, current
from docspark.sources.documents import elements_of, read_documents
from docspark.sources.store import ChunkStore, dump_json
from docspark.sources.tables import table
from docspark.work import Work

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)

# Steps of ingestion in order, with the share done while a paper is in that step.
STEPS = (("queued", 0), ("parse", 20), ("chunk", 40), ("embed", 60), ("index", 80))
_SLOT = "(('0x' || md5(term)[1:8])::BIGINT % {n})"


@query("WITH " + _CUR + f""", t AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(coalesce(text_for_embedding, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM cur)),
n AS (SELECT chunk_id, term, count(*)::DOUBLE AS n, count(*) FILTER (WHERE pos <= 512) AS tf FROM t GROUP BY 1, 2), s AS (SELECT chunk_id, {_SLOT.format(n=64)} AS slot, sum(n) AS n FROM n GROUP BY 1, 2), l AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM s GROUP BY 1),
h AS (SELECT * FROM n WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), z AS (SELECT count(*) AS total FROM cur)
SELECT s.chunk_id, 'dense' AS kind, slot AS i, round(s.n / norm, 6) AS value FROM s JOIN l ON l.chunk_id = s.chunk_id UNION ALL
SELECT chunk_id, 'sparse', {_SLOT.format(n=30000).replace('term', 'h.term')}, round(sum(ln(1 + tf) * ln((total + 1) / (df + 1))), 6) FROM h JOIN df ON df.term = h.term, z GROUP BY 1, 3 HAVING sum(ln(1 + tf) * ln((total + 1) / (df + 1))) > 0""")
def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The dense and sparse columns the engine itself gives every chunk, one row per entry that is not 0."""
    rows = current(spark, d, "text_for_embedding").select(F.col("chunk_id").alias("id"), F.col("text_for_embedding").alias("text"))
    work = Work(spark, "encode")
    made = work.table(encode.embed(rows, work), "vectors")
    dense = made.select(F.col("id").alias("chunk_id"), F.lit("dense").alias("kind"), F.posexplode("dense").alias("i", "value")).where("value <> 0")
    sparse = made.select(F.col("id").alias("chunk_id"), F.lit("sparse").alias("kind"), F.explode(F.arrays_zip("sparse_indices", "sparse_values")).alias("x")).select("chunk_id", "kind", F.col("x.sparse_indices").alias("i"), F.col("x.sparse_values").alias("value"))
    return dense.unionByName(sparse).select("chunk_id", "kind", F.col("i").cast("long").alias("i"), F.round("value", 6).alias("value"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    c = current(spark, d, "text_for_embedding", "page_range", "order_range", "is_key_section")
    at = lambda column, k: F.coalesce(F.try_element_at(column, F.lit(k)), F.lit(0)).cast("long")
    rows = _members(spark, d).where("paper_id is not null").join(c, "chunk_id").select(
        "paper_id",
        "cluster_id",
        F.struct(at("order_range", 1).alias("o"), "chunk_id").alias("at"),
        F.col("chunk_id").alias("id"),
        F.col("text_for_embedding").alias("text"),
        at("page_range", 1).alias("first_page"),
        at("page_range", -1).alias("last_page"),
        at("order_range", 1).alias("first_order"),
        at("order_range", -1).alias("last_order"),
        F.coalesce("is_key_section", F.lit(False)).alias("key"),
    )
    place = F.row_number().over(Window.partitionBy("paper_id", "cluster_id").orderBy("at"))
    return trees.tree_nodes(rows.withColumn("pos", place).drop("at"), Work(spark, "nodes"))


def _ends(t: str) -> str:
    s = _ENDS.replace("string_split(text,", f"string_split(coalesce({t}, ''),")
    return f"(SELECT CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN s[1] || '.' ELSE s[1] || '. ' || s[-1] || '.' END FROM (SELECT {s} AS s))"


def _node(level: int) -> str:
    return f"""replace(paper_id, ' ', '_')[1:30] || '_L{level}_' || CASE WHEN no < 10000 THEN lpad(no::VARCHAR, 4, '0') ELSE no::VARCHAR END AS node_id, {level} AS level, string_agg(id, ',' ORDER BY pos) AS children, arg_min(first_page, pos) AS first_page, arg_max(last_page, pos) AS last_page,
 arg_min(first_order, pos) AS first_order, arg_max(last_order, pos) AS last_order, arg_min(key, pos) AS key, string_agg(ends, ' ' ORDER BY pos) AS text"""


_NODES = f"""{_CUR}, {_CLUSTER}, r AS (SELECT m.paper_id, m.cluster_id AS no, c.chunk_id AS id, coalesce(page_range[1], 0) AS first_page, coalesce(page_range[-1], 0) AS last_page, coalesce(order_range[1], 0) AS first_order, coalesce(order_range[-1], 0) AS last_order, coalesce(is_key_section, false) AS key,
 {_ends('c.text_for_embedding')} AS ends, row_number() OVER (PARTITION BY m.paper_id, m.cluster_id ORDER BY coalesce(order_range[1], 0), c.chunk_id) AS pos, count(*) OVER (PARTITION BY m.paper_id, m.cluster_id) AS n FROM m JOIN cur c ON c.chunk_id = m.chunk_id WHERE m.paper_id IS NOT NULL),
n1 AS (SELECT paper_id, no, {_node(1)} FROM r WHERE n >= 3 GROUP BY paper_id, no),
r2 AS (SELECT paper_id, floor((k - 1) / ceil(n / least(3, greatest(2, n // 3))))::BIGINT AS no, no AS pos, node_id AS id, first_page, last_page, first_order, last_order, key, {_ends('text')} AS ends FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY no) AS k, count(*) OVER (PARTITION BY paper_id) AS n FROM n1) WHERE n >= 2),
n2 AS (SELECT paper_id, no, {_node(2)} FROM r2 GROUP BY paper_id, no),
r3 AS (SELECT paper_id, 0 AS no, no AS pos, node_id AS id, first_page, last_page, first_order, last_order, key, {_ends('text')} AS ends FROM (SELECT * FROM n2 UNION ALL SELECT * FROM n1 WHERE paper_id NOT IN (SELECT paper_id FROM n2))),
n3 AS (SELECT paper_id, no, {_node(3)} FROM r3 GROUP BY paper_id, no),
nodes AS (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3), up AS (SELECT paper_id, node_id AS parent_id, unnest(string_split(children, ',')) AS node_id FROM nodes WHERE level > 1)"""


@query("WITH " + _NODES + """ SELECT n.paper_id, n.node_id, n.level::BIGINT AS level, u.parent_id, children, count(*) OVER (PARTITION BY n.paper_id, n.level) - 1 AS n_siblings, first_page::BIGINT AS first_page, last_page::BIGINT AS last_page, first_order::BIGINT AS first_order, last_order::BIGINT AS last_order, key, md5(text) AS text_hash
FROM nodes n LEFT JOIN up u ON u.paper_id = n.paper_id AND u.node_id = n.node_id""")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The summary nodes of every paper's tree with their links, ranges and texts."""
    n = _nodes(spark, d)
    return n.select("paper_id", "node_id", "level", "parent_id", F.array_join("children", ",").alias("children"), "n_siblings", "first_page", "last_page", "first_order", "last_order", "key", F.md5("text").alias("text_hash"))


@query("WITH " + _NODES + """, k AS (SELECT paper_id, count(*) FILTER (WHERE level = 1) AS l1, count(*) FILTER (WHERE level = 2) AS l2, count(*) FILTER (WHERE level = 3) AS l3 FROM nodes GROUP BY 1),
h AS (SELECT paper_id, count(*) FILTER (WHERE level = 0) AS leaves, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level = 2) AS h2, count(*) FILTER (WHERE level = 3) AS h3 FROM cur WHERE paper_id IS NOT NULL GROUP BY 1)
SELECT h.paper_id, leaves, coalesce(l1, 0) AS l1_nodes, coalesce(l2, 0) AS l2_nodes, coalesce(l3, 0) AS l3_root, leaves + coalesce(l1 + l2 + l3, 0) AS total_nodes, CASE WHEN h1 < coalesce(l1, 0) THEN coalesce(l1 + l2 + l3, 0) ELSE CASE WHEN h2 < coalesce(l2, 0) THEN l2 ELSE 0 END + CASE WHEN h3 < coalesce(l3, 0) THEN l3 ELSE 0 END END AS nodes_upserted,
CASE WHEN l1 IS NULL THEN 'NO_CLUSTERS' WHEN h1 >= l1 AND h2 >= l2 AND h3 >= l3 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status FROM h LEFT JOIN k ON k.paper_id = h.paper_id""")
def build_report(spark: SparkSession, d: str) -> DataFrame:
    """Per paper the nodes of each level, how many a build writes, and whether it is skipped because all are stored."""
    per = lambda df, names: df.groupBy("paper_id").agg(*[F.count_if(F.col("level") == k).alias(n) for k, n in names.items()])
    k = per(_nodes(spark, d), {1: "l1", 2: "l2", 3: "l3"})
    h = per(current(spark, d, "paper_id", "level").where("paper_id is not null"), {0: "leaves", 1: "h1", 2: "h2", 3: "h3"})
    both = h.join(k, "paper_id", "left").withColumn("none", F.col("l1").isNull()).fillna(0, ["l1", "l2", "l3"])
    built = F.col("l1") + F.col("l2") + F.col("l3")
    short = lambda n: F.when(F.col(f"h{n}") < F.col(f"l{n}"), F.col(f"l{n}")).otherwise(0)
    status = F.when(F.col("none"), "NO_CLUSTERS").when(F.expr("h1 >= l1 and h2 >= l2 and h3 >= l3"), "SKIPPED").otherwise("SUCCESS")
    return both.select("paper_id", "leaves", F.col("l1").alias("l1_nodes"), F.col("l2").alias("l2_nodes"), F.col("l3").alias("l3_root"), (F.col("leaves") + built).alias("total_nodes"), F.when(F.expr("h1 < l1"), built).otherwise(short(2) + short(3)).alias("nodes_upserted"), status.alias("status"))


_ENRICHED = f"""enriched AS (SELECT p.paper_id, p.chunk_id, e.key AS cluster, e.value AS score FROM (SELECT paper_id, chunk_id, unnest(map_entries(cluster_probabilities)) AS e FROM cur) p WHERE e.value >= 0.25),
every AS (SELECT paper_id, chunk_id, cluster_id::VARCHAR AS cluster, 1.0::DOUBLE AS score FROM m WHERE chunk_id IS NOT NULL AND paper_id IS NOT NULL UNION ALL SELECT paper_id, chunk_id, cluster, score FROM enriched WHERE paper_id IS NOT NULL),
united AS (SELECT paper_id, chunk_id, cluster, max(score) AS score, count(*) FILTER (WHERE score = 1.0) > 0 AS listed FROM every GROUP BY 1, 2, 3)"""


def _united(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each cluster: those listed (score 1) and those that belong to it by probability."""
    home = _members(spark, d).where("paper_id is not null").select("paper_id", "chunk_id", F.col("cluster_id").cast("string").alias("cluster"), F.lit(1.0).alias("score"))
    p = current(spark, d, "paper_id", "cluster_probabilities").select("paper_id", "chunk_id", F.explode("cluster_probabilities").alias("cluster", "score")).where("score >= 0.25 and paper_id is not null")
    return home.unionByName(p.select(*home.columns)).groupBy("paper_id", "chunk_id", "cluster").agg(F.max("score").alias("score"))


@query("WITH " + _CUR + f", {_CLUSTER}, {_ENRICHED} SELECT paper_id, cluster, chunk_id, round(score, 6) AS score FROM united")
def cluster_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of a cluster's listed chunks and those that belong to it by probability."""
    return _united(spark, d).select("paper_id", "cluster", "chunk_id", F.round("score", 6).alias("score"))


@query("WITH " + _CUR + f""", {_CLUSTER}, {_ENRICHED}, s AS (SELECT paper_id, chunk_id, string_agg(cluster || ':' || round(score, 4)::DECIMAL(6, 4)::VARCHAR, ',' ORDER BY cluster) AS probabilities, count(*) AS n FROM united GROUP BY 1, 2)
SELECT c.chunk_id, coalesce(s.n, 0) AS n_clusters, coalesce(s.probabilities, '') AS probabilities, coalesce(u.parents, '') AS parents FROM cur c LEFT JOIN s ON s.paper_id = c.paper_id AND s.chunk_id = c.chunk_id
LEFT JOIN (SELECT child, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS parents FROM (SELECT chunk_id, unnest(children_ids) AS child FROM cur WHERE level >= 1) GROUP BY 1) u ON u.child = c.chunk_id WHERE c.level = 0""")
def leaf_links(spark: SparkSession, d: str) -> DataFrame:
    """What one update writes back to every leaf: its clusters with their probabilities, and its parents."""
    c = current(spark, d, "paper_id", "level", "children_ids")
    told = F.concat(F.col("cluster"), F.lit(":"), F.col("score").cast("decimal(6,4)").cast("string"))
    own = _united(spark, d).groupBy("paper_id", "chunk_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cluster", told.alias("t")))), lambda x: x["t"]), ",").alias("probabilities"))
    up = c.where("level >= 1").select(F.col("chunk_id").alias("parent"), F.explode("children_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.array_join(F.sort_array(F.collect_set("parent")), ",").alias("parents"))
    blank = F.lit("")
    return c.where("level = 0").select("paper_id", "chunk_id").join(own, ["paper_id", "chunk_id"], "left").join(up, "chunk_id", "left").select("chunk_id", F.coalesce("n", F.lit(0)).alias("n_clusters"), F.coalesce("probabilities", blank).alias("probabilities"), F.coalesce("parents", blank).alias("parents"))


@query("WITH " + _CUR + f", {_CLUSTER} SELECT paper_id, chunk_id FROM cur WHERE level = 0 AND chunk_id NOT IN (SELECT chunk_id FROM m WHERE chunk_id IS NOT NULL)")
def unclustered_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that no structural cluster lists: empty where every leaf is clustered."""
    leaves = current(spark, d, "paper_id", "level").where("level = 0").select("paper_id", "chunk_id")
    return leaves.join(_members(spark, d).select("chunk_id"), "chunk_id", "left_anti").select("paper_id", "chunk_id")


@query("WITH " + _CUR + " SELECT DISTINCT 'edge' AS kind, paper_id, chunk_id AS id, child AS other FROM (SELECT paper_id, chunk_id, unnest(children_ids) AS child FROM cur) WHERE child <> '' UNION ALL SELECT 'node', paper_id, chunk_id, level::VARCHAR FROM cur")
def tree_graph_rows(spark: SparkSession, d: str) -> DataFrame:
    """The stored trees as node rows (with their level) and edge rows."""
    c = current(spark, d, "paper_id", "level", "children_ids")
    edges = c.select(F.lit("edge").alias("kind"), "paper_id", F.col("chunk_id").alias("id"), F.explode("children_ids").alias("other")).where("other <> ''").distinct()
    return edges.union(c.select(F.lit("node"), "paper_id", "chunk_id", F.col("level").cast("string")))


_HAVE = "e AS (SELECT DISTINCT paper_id FROM elements), c AS (SELECT paper_id, count(*) AS n, count(dense_vector) AS v FROM chunks WHERE level = 0 GROUP BY 1)"


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with what the pipeline has left of it: elements, leaf chunks, vectors."""
    e = table(spark, d, "elements").select("paper_id").distinct().withColumn("parsed", F.lit(True))
    c = table(spark, d, "chunks").where("level = 0").groupBy("paper_id").agg(F.count("*").alias("n"), F.count("dense_vector").alias("v"))
    return table(spark, d, "papers").select("paper_id", "source", "rag_status").join(e, "paper_id", "left").join(c, "paper_id", "left")


@query(f"""WITH {_HAVE}, s AS (SELECT p.paper_id, coalesce(rag_status, 'none') AS status, CASE WHEN rag_status = 'processing' THEN CASE WHEN c.v > 0 THEN 'index' WHEN c.n > 0 THEN 'embed' WHEN e.paper_id IS NOT NULL THEN 'chunk' ELSE 'parse' END END AS step FROM papers p LEFT JOIN e ON e.paper_id = p.paper_id LEFT JOIN c ON c.paper_id = p.paper_id)
SELECT paper_id, status, CASE status WHEN 'none' THEN 0 WHEN 'ready' THEN 100 WHEN 'failed' THEN 100 ELSE CASE step {" ".join(f"WHEN '{n}' THEN {v}" for n, v in STEPS)} ELSE 0 END END::BIGINT AS progress, step FROM s""")
def paper_status(spark: SparkSession, d: str) -> DataFrame:
    """Status, progress and current step of every paper; the step follows from what is stored."""
    step = F.when(F.col("v") > 0, "index").when(F.col("n") > 0, "embed").when(F.col("parsed"), "chunk").otherwise("parse")
    rows = _progress(spark, d).select("paper_id", F.coalesce("rag_status", F.lit("none")).alias("status"), F.when(F.col("rag_status") == "processing", step).alias("step"))
    return rows.select("paper_id", "status", text.progress(F.col("status"), F.col("step"), STEPS).alias("progress"), "step")


@query(f"WITH {_HAVE} SELECT lower(p.source) AS source, count(*) AS n_papers, count(*) FILTER (WHERE c.n > 0) AS succeeded, count(*) FILTER (WHERE coalesce(c.n, 0) = 0) AS failed FROM papers p LEFT JOIN c ON c.paper_id = p.paper_id GROUP BY 1")
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Papers of every source that came out with chunks, and those that did not."""
    done = F.coalesce("n", F.lit(0)) > 0
    return _progress(spark, d).groupBy(F.lower("source").alias("source")).agg(F.count("*").alias("n_papers"), F.count_if(done).alias("succeeded"), F.count_if(~done).alias("failed"))


@query("""WITH v AS (SELECT * FROM chat_messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1), n AS (SELECT max(updated_at) - INTERVAL 30 DAY AS since FROM chat_messages)
SELECT session_id, count(*) FILTER (WHERE deleted_at IS NULL) AS n_live, count(*) FILTER (WHERE deleted_at >= since) AS n_kept_deleted, count(*) FILTER (WHERE deleted_at < since) AS n_purged FROM v, n GROUP BY 1""")
def purge_messages(spark: SparkSession, d: str) -> DataFrame:
    """Per session: messages that live, those deleted within 30 days of the newest row, and those a purge removes."""
    m = table(spark, d, "chat_messages").where("id is not null")
    one = m.groupBy("id").agg(F.max_by(F.struct("session_id", "deleted_at"), "updated_at").alias("m")).select("m.*")
    now = m.agg((F.max("updated_at") - F.expr("interval 30 days")).alias("since"))  # one row
    gone = F.col("deleted_at") < F.col("since")
    return one.join(F.broadcast(now), how="cross").groupBy("session_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("n_live"), F.count_if(~gone).alias("n_kept_deleted"), F.count_if(gone).alias("n_purged"))


@query("""WITH a AS (SELECT DISTINCT x.name AS collection, paper_id FROM (SELECT paper_id, unnest(authors) AS x FROM papers) WHERE x.name IS NOT NULL)
SELECT a.collection, p.paper_id, row_number() OVER (PARTITION BY a.collection ORDER BY p.updated_at DESC NULLS LAST, p.paper_id) AS place FROM papers p JOIN a ON a.paper_id = p.paper_id WHERE p.rag_status = 'ready'""")
def collection_papers(spark: SparkSession, d: str) -> DataFrame:
    """The ready papers of every collection (an author's), latest change first."""
    p = table(spark, d, "papers")
    member = p.select(F.explode("authors").alias("a"), "paper_id").where("a.name is not null").select(F.col("a.name").alias("collection"), "paper_id").distinct()
    rows = p.where("rag_status = 'ready'").select("paper_id", "updated_at").join(member, "paper_id")
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.col("updated_at").desc_nulls_last(), "paper_id"))
    return rows.select("collection", "paper_id", place.alias("place"))


@query(f"""WITH s AS (SELECT user_id, paper_id, unnest(sources) AS x FROM chat_messages WHERE user_id IS NOT NULL), t AS (SELECT DISTINCT user_id, paper_id, {_strip('x.section')}.lower()[1:50] AS tag FROM s WHERE x.section IS NOT NULL)
SELECT user_id, paper_id, tag, row_number() OVER (PARTITION BY user_id, paper_id ORDER BY tag) AS place FROM t""")
def paper_tags(spark: SparkSession, d: str) -> DataFrame:
    """The tags of each user on each paper (the sections their answers drew on), in order."""
    s = table(spark, d, "chat_messages").where("user_id is not null").select("user_id", "paper_id", F.explode("sources").alias("x")).where("x.section is not null")
    tags = s.select("user_id", "paper_id", text.tag_label(F.col("x.section")).alias("tag")).distinct()
    return tags.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "paper_id").orderBy("tag")))


@query("WITH " + _CUR + f""", src AS (SELECT s.chunk_id, any_value(s.text_for_embedding) AS summary, string_agg(c.text_for_embedding, chr(10) || chr(10) ORDER BY c.chunk_id) AS source FROM (SELECT DISTINCT chunk_id, text_for_embedding, unnest(children_ids) AS child FROM cur WHERE level >= 1) s JOIN cur c ON c.chunk_id = s.child WHERE c.text_for_embedding IS NOT NULL GROUP BY 1),
v AS (SELECT {_tokens('summary')} AS n_out, {_tokens('source')} AS n_in, CASE WHEN summary IS NULL OR trim(summary) = '' THEN 'EMPTY_SUMMARY' WHEN {_tokens('source')} > 50 AND ({_tokens('summary')}) / greatest({_tokens('source')}, 1) > 0.6 THEN 'FAILED_COMPRESSION'
WHEN len(list_filter({_NUM.format(t='summary')}, lambda n: n::DOUBLE > 10 AND NOT list_contains({_NUM.format(t='source')}, n))) > 0 THEN 'FAILED_HALLUCINATION' ELSE 'PASSED' END AS verdict FROM src)
SELECT count(*) AS total_calls, count(*) FILTER (WHERE verdict = 'PASSED') AS successful_calls, count(*) FILTER (WHERE verdict LIKE 'FAILED%') AS extractive_calls, count(*) FILTER (WHERE verdict = 'EMPTY_SUMMARY') AS failed_calls, sum(n_in)::BIGINT AS total_input_tokens, sum(n_out)::BIGINT AS total_output_tokens FROM v""")
def summary_counters(spark: SparkSession, d: str) -> DataFrame:
    """The summariser's counters over all stored summaries: those that pass, those replaced by an extract, empty ones, tokens in and out."""
    from docspark.plans.trees import summaries_judged

    v = summaries_judged(spark, d)
    is_ = lambda kind: F.count_if(F.col("verdict").startswith(kind))
    return v.agg(
        F.count("*").alias("total_calls"), is_("PASSED").alias("successful_calls"), is_("FAILED").alias("extractive_calls"), is_("EMPTY").alias("failed_calls"), F.sum(text.count_tokens(F.col("source"))).alias("total_input_tokens"), F.sum(text.count_tokens(F.col("summary"))).alias("total_output_tokens")
    )


@query("""SELECT model, CASE WHEN contains(m, 'gemini') THEN 'gemini' WHEN contains(m, 'groq') THEN 'groq' WHEN contains(m, 'openrouter') THEN 'openrouter' WHEN contains(m, 'gpt') OR contains(m, 'openai') THEN 'openai' WHEN contains(m, 'claude') OR contains(m, 'anthropic') THEN 'anthropic' WHEN contains(m, 'ollama') THEN 'ollama' ELSE 'unknown' END AS provider, n
FROM (SELECT model, lower(model) AS m, count(*) AS n FROM (SELECT embedding_model AS model FROM chunks UNION ALL SELECT x || '/' || embedding_model FROM chunks, (VALUES ('Gemini'), ('groq'), ('openrouter/gpt'), ('OpenAI'), ('claude'), ('ollama')) v(x)) GROUP BY 1, 2)""")
def model_providers(spark: SparkSession, d: str) -> DataFrame:
    """The provider each model name stands for, over the stored names with and without a prefix."""
    c = table(spark, d, "chunks").groupBy("embedding_model").agg(F.count("*").alias("n"))
    prefixes = F.array(*[F.lit(x) for x in ("", "Gemini/", "groq/", "openrouter/gpt/", "OpenAI/", "claude/", "ollama/")])
    named = c.select(F.explode(prefixes).alias("x"), "embedding_model", "n").select(F.concat("x", "embedding_model").alias("model"), "n")
    named = named.groupBy("model").agg(F.sum("n").alias("n"))
    return named.select("model", text.provider(F.col("model")).alias("provider"), "n")


@query(r"""SELECT paper_id, sha256(title) AS file_hash, octet_length(encode(title))::BIGINT AS n_bytes, octet_length(encode(title)) <= 52428800 AS allowed, regexp_replace(regexp_replace(lower(title), '[^a-z0-9._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')[1:100] || '.pdf' AS file_name FROM papers WHERE title IS NOT NULL""")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hash, size limit and clean name of every file (its bytes are the title's here; a source of files gives its own)."""
    rows = table(spark, d, "papers").where("title is not null").select("paper_id", F.col("title").cast("binary").alias("content"), "title")
    return rows.select("paper_id", *[c.alias(n) for n, c in text.file_facts(F.col("content"), F.col("title")).items()])


@query("SELECT paper_id, count(*) AS n_elements, count(DISTINCT element_id) AS n_ids, count(*) FILTER (WHERE type = 'table') AS n_tables, sum(coalesce(content.token_count, 0))::BIGINT AS tokens, max(location.order)::BIGINT AS last_order FROM elements WHERE paper_id IS NOT NULL GROUP BY 1")
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Elements written as one JSON document per paper and read back by the source for parsed documents."""
    e = table(spark, d, "elements").where("paper_id is not null")
    kept = ("element_id", "type", "location", "section", "content", "references", "surrounding_context", "phase2_ready", "adjacency")
    folder = Work(spark, "documents").path("papers")
    documents = e.groupBy("paper_id").agg(F.collect_list(F.struct(*kept)).alias("elements")).select(F.struct("paper_id").alias("document"), "elements", F.col("paper_id").alias("paper"))
    documents.write.partitionBy("paper").json(folder)
    rows = elements_of(read_documents(spark, folder, "*/*.json"))
    return rows.groupBy("paper_id").agg(
        F.count("*").alias("n_elements"), F.count_distinct("element_id").alias("n_ids"), F.count_if(F.col("type") == "table").alias("n_tables"), F.sum(F.coalesce("content.token_count", F.lit(0))).alias("tokens"), F.max("location.order").alias("last_order")
    )


@query("WITH " + _CUR + """, k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY chunk_id) AS r FROM cur WHERE paper_id IS NOT NULL AND content_hash IS NOT NULL AND level IS NOT NULL)
SELECT paper_id, level::BIGINT AS level, count(*) AS n_rows, count(*) FILTER (WHERE level = 0) AS n_linked FROM k WHERE r = 1 AND level < 2 GROUP BY 1, 2""")
def store_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A chunk store filled, filled again (nothing new), rid of its upper levels, its links updated, dumped as JSON and read back."""
    work = Work(spark, "store")
    c = current(spark, d, "paper_id", "level", "content_hash", "parent_ids").where("paper_id is not null and content_hash is not null and level is not null")
    first = F.row_number().over(Window.partitionBy("paper_id", "content_hash").orderBy("chunk_id"))
    rows = work.table(c.withColumn("r", first).where("r = 1").drop("r"), "rows")
    store = ChunkStore(spark, work.path("chunks"), rows.schema)
    store.upsert(rows)
    again = store.upsert(rows)
    store.delete_levels(2)
    store.update_links(store.scan(levels=[0]).select("chunk_id", F.array(F.lit("linked")).alias("parent_ids")))
    dump = work.path("dump")
    dump_json(store.read().select("paper_id", "level", "chunk_id", "parent_ids"), dump)
    back = spark.read.schema("paper_id string, level long, chunk_id string, parent_ids array<string>").json(dump)
    linked = F.coalesce(F.get("parent_ids", F.lit(0)) == "linked", F.lit(False))
    return back.groupBy("paper_id", "level").agg((F.count("*") + again).alias("n_rows"), F.count_if(linked).alias("n_linked"))
