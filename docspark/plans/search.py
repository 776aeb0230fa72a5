"""Retrieval queries over the stored chunks.

The query set is every leaf chunk whose sequence index is divisible by 50; the queries named ``..._all_levels`` take
the summaries with such an index too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import signals
from docspark.functions.text import count_tokens
from docspark.operators import knn, retrieval
from docspark.plans import registry
from docspark.plans.textual import _or, _strip, _sum, _tokens
from docspark.sources.tables import table
from docspark.work import Work

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)

_COLUMNS = (
    "paper_id level chunk_sequence_index section_title is_key_section section_importance has_table has_equation has_figure text_for_embedding text_for_display token_count "
    "parent_ids children_ids cluster_ids cluster_probabilities equation_latex dense_vector sparse_indices sparse_values"
).split()
_CUR = """cur AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(ingested_at AS TIMESTAMPTZ) DESC NULLS LAST,
 coalesce(array_to_string(children_ids, ','), '') DESC, coalesce(array_to_string(parent_ids, ','), '') DESC, coalesce(array_to_string(sibling_ids, ','), '') DESC) = 1)"""
_Q = f"""q AS (SELECT *, CASE WHEN table_signal OR equation_signal OR figure_signal THEN 'D' WHEN cross_section OR broad > specific + 1 THEN 'B' WHEN specific > broad + 1 OR num THEN 'A' ELSE 'C' END AS mode FROM (
 SELECT chunk_id AS query_id, paper_id, query_text, dense_vector AS u, sparse_indices AS ui, sparse_values AS uv, {_sum(signals.SPECIFIC)} + num::INT AS specific, {_sum(signals.BROAD)} + 3 AS broad,
 ({_or(signals.TABLE)}) AS table_signal, ({_or(signals.EQUATION)}) AS equation_signal, ({_or(signals.FIGURE)}) AS figure_signal, ({_or(signals.CROSS_SECTION)}) AS cross_section, num
 FROM (SELECT *, regexp_matches(q, '{signals.NUMBER}') AS num FROM (SELECT *, text_for_embedding AS query_text, coalesce({_strip('lower(text_for_embedding)')}, '') AS q FROM cur WHERE level = 0 AND chunk_sequence_index % 50 = 0)))),
p0 AS (SELECT *, CASE mode WHEN 'A' THEN 0.4 WHEN 'B' THEN 0.65 ELSE 0.5 END AS dw, CASE mode WHEN 'A' THEN 0.6 WHEN 'B' THEN 0.35 ELSE 0.5 END AS sw, CASE mode WHEN 'B' THEN 6 WHEN 'C' THEN 12 ELSE 8 END AS k,
 CASE mode WHEN 'B' THEN 1 ELSE 0 END AS lo, CASE mode WHEN 'A' THEN 0 WHEN 'B' THEN 3 ELSE 99 END AS hi, CASE mode WHEN 'C' THEN 5 ELSE 4 END AS rn, mode <> 'A' AS boosted FROM q)"""
_PLAIN = "p AS (SELECT * FROM p0)"
#: Broad queries without any summary that a leg would find are searched over all levels.
_FALL = """found AS (SELECT DISTINCT query_id FROM p0 JOIN cur c ON c.paper_id = p0.paper_id WHERE mode = 'B' AND c.level BETWEEN 1 AND 3 AND (coalesce(round(CASE WHEN list_dot_product(u, u) * list_dot_product(c.dense_vector, c.dense_vector) = 0 THEN 0 ELSE list_dot_product(u, c.dense_vector)
 / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c.dense_vector, c.dense_vector))) END, 6) >= 0, false) OR coalesce(len(ui) = len(uv) AND len(c.sparse_indices) = len(c.sparse_values) AND list_has_any(ui, c.sparse_indices), false))),
p AS (SELECT * REPLACE (CASE WHEN again THEN 0.5 ELSE dw END AS dw, CASE WHEN again THEN 0.5 ELSE sw END AS sw, CASE WHEN again THEN 8 ELSE k END AS k, CASE WHEN again THEN 0 ELSE lo END AS lo, CASE WHEN again THEN 99 ELSE hi END AS hi) FROM (SELECT *, mode = 'B' AND query_id NOT IN (SELECT query_id FROM found) AS again FROM p0))"""
_OK = "c.level BETWEEN p.lo AND p.hi AND (NOT table_signal OR coalesce(has_table, false)) AND (NOT equation_signal OR coalesce(has_equation, false)) AND (NOT figure_signal OR coalesce(has_figure, false))"
_RANKED = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k}"
_DENSE = f"""dense0 AS (SELECT p.query_id, c.chunk_id, p.k, round(CASE WHEN list_dot_product(u, u) * list_dot_product(c.dense_vector, c.dense_vector) = 0 THEN 0 ELSE list_dot_product(u, c.dense_vector) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c.dense_vector, c.dense_vector))) END, 6) AS score
 FROM p JOIN cur c ON c.paper_id = p.paper_id AND {_OK} WHERE u IS NOT NULL AND c.dense_vector IS NOT NULL),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense0 WHERE score >= 0 {_RANKED.format(k='k')})"""
_SPARSE = f"""qt AS (SELECT query_id, unnest(ui) AS term, unnest(uv) AS uw FROM p WHERE len(ui) = len(uv)), ct AS (SELECT chunk_id, paper_id, unnest(sparse_indices) AS term, unnest(sparse_values) AS w FROM cur WHERE len(sparse_indices) = len(sparse_values)),
sparse0 AS (SELECT p.query_id, c.chunk_id, p.k, round(sum(qt.uw * ct.w), 6) AS score FROM p JOIN qt ON qt.query_id = p.query_id JOIN ct ON ct.paper_id = p.paper_id AND ct.term = qt.term JOIN cur c ON c.chunk_id = ct.chunk_id WHERE {_OK} GROUP BY 1, 2, 3),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse0 {_RANKED.format(k='k')})"""
_FUSED = """fused AS (SELECT l.query_id, chunk_id, round(sum(CASE leg WHEN 'd' THEN dw ELSE sw END / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank, 'd' AS leg FROM dense UNION ALL SELECT query_id, chunk_id, rank, 's' FROM sparse) l JOIN p ON p.query_id = l.query_id GROUP BY 1, 2)"""
_TOP = f"""boosted AS (SELECT f.query_id, f.chunk_id, p.k, round(f.score * CASE WHEN p.boosted THEN CASE c.level WHEN 1 THEN 1.10 WHEN 2 THEN 1.05 WHEN 3 THEN 1.08 ELSE 1.0 END::DOUBLE * CASE WHEN coalesce(c.is_key_section, false) THEN 1.05 ELSE 1.0 END::DOUBLE
 * CASE c.section_importance WHEN 'high' THEN 1.05 WHEN 'low' THEN 0.95 ELSE 1.0 END::DOUBLE ELSE 1.0 END, 9) AS score FROM fused f JOIN cur c ON c.chunk_id = f.chunk_id JOIN p ON p.query_id = f.query_id),
top AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM boosted {_RANKED.format(k='k')})"""


def _kids(source: str, n: int, default: str, only: str = "") -> str:
    return f"""(SELECT query_id, summary_id, x.chunk_id, coalesce(cluster_probabilities[cl], {default})::DOUBLE AS membership FROM (SELECT s.query_id, s.chunk_id AS summary_id, c.cluster_ids[1]::VARCHAR AS cl, unnest(c.children_ids) AS chunk_id, generate_subscripts(c.children_ids, 1) AS pos FROM {source} s JOIN cur c ON c.chunk_id = s.chunk_id WHERE c.level >= 1{only}) x
 JOIN cur k ON k.chunk_id = x.chunk_id QUALIFY row_number() OVER (PARTITION BY query_id, summary_id ORDER BY coalesce(cluster_probabilities[cl], {default}) DESC, pos, x.chunk_id) <= {n})"""


_CANDIDATES = f"""cand AS (SELECT query_id, chunk_id, arg_min(score, source) AS score, min(source) AS source FROM (SELECT query_id, chunk_id, score, 0 AS source FROM top UNION ALL SELECT query_id, chunk_id, 0.5, 1 FROM {_kids('top', 3, '0.0', " AND s.query_id IN (SELECT query_id FROM p WHERE mode = 'B')")}) GROUP BY 1, 2)"""
_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^a-z0-9]+'), lambda w: w <> ''))"
_RERANK = f"""scored AS (SELECT query_id, chunk_id, rn, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS score FROM (SELECT h.query_id, h.chunk_id, p.rn, {_TERMS.format(t='p.query_text')} AS a, {_TERMS.format(t='c.text_for_display')} AS b
 FROM cand h JOIN p ON p.query_id = h.query_id JOIN cur c ON c.chunk_id = h.chunk_id)),
rr AS (SELECT query_id, chunk_id, score AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= rn AND (score >= 0.25 OR rank = 1))"""
_TRAVERSE = f"""reached AS (SELECT query_id, chunk_id, rerank_score, 'direct' AS fetched_as, 0 AS source FROM rr UNION ALL
 SELECT r.query_id, c.parent_ids[1], round(r.rerank_score * 0.8, 6), 'traversal_parent', 1 FROM rr r JOIN cur c ON c.chunk_id = r.chunk_id WHERE c.level = 0 AND c.parent_ids[1] IN (SELECT chunk_id FROM cur) UNION ALL
 SELECT k.query_id, k.chunk_id, round(k.membership * r.rerank_score, 6), 'traversal_child', 2 FROM {_kids('rr', 2, '0.1')} k JOIN rr r ON r.query_id = k.query_id AND r.chunk_id = k.summary_id),
tr AS (SELECT query_id, chunk_id, rerank_score, fetched_as FROM reached QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source, rerank_score DESC) = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


#: The query sets, in words that Spark and DuckDB share.
_LEAVES, _ALL = "level = 0 AND chunk_sequence_index % 50 = 0", "chunk_sequence_index % 50 = 0"


def staged(spark: SparkSession, d: str, asked: str = _LEAVES) -> tuple[Work, DataFrame, DataFrame]:
    """Written once: the newest row of every chunk with the columns retrieval needs, and the plans of the query set."""
    work = Work(spark, "search")
    chunks = work.table(retrieval.newest(table(spark, d, "chunks"), columns=("chunk_id", *_COLUMNS)), "chunks")
    q = chunks.where(asked)
    q = q.select(F.col("chunk_id").alias("query_id"), "paper_id", F.col("text_for_embedding").alias("query_text"), "dense_vector", "sparse_indices", "sparse_values")
    # the signals are written too: every field of the plan refers to them
    q = work.table(q.select("*", *[c.alias(n) for n, c in signals.signals(F.col("query_text")).items()]), "signals")
    q = work.table(q.withColumn("mode", signals.mode()), "modes")
    return work, chunks, q.select("*", *[c.alias(n) for n, c in signals.plan(F.col("mode")).items()])


@query("""SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 50."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.top_k(rows.where("id % 50 = 0"), rows, 10)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3")
def semantic_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one label that are alike."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.similar_pairs(rows, 0.3)


@query(_with(_CUR, _Q, _PLAIN, _DENSE) + "SELECT query_id, chunk_id, score, rank FROM dense")
def dense_search(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    _, c, p = staged(spark, d, asked)
    return retrieval.dense_leg(p, c)


@query(_with(_CUR, _Q, _PLAIN, _SPARSE) + "SELECT query_id, chunk_id, score, rank FROM sparse")
def sparse_search(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    _, c, p = staged(spark, d, asked)
    return retrieval.sparse_leg(p, c)


@query(_with(_CUR, _Q, _PLAIN, _DENSE, _SPARSE, _FUSED) + "SELECT query_id, chunk_id, score FROM fused")
def hybrid_rrf(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    _, c, p = staged(spark, d, asked)
    return retrieval.fuse(retrieval.dense_leg(p, c), retrieval.sparse_leg(p, c), p)


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP) + "SELECT query_id, chunk_id, score, rank FROM top")
def hybrid_boosted(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    work, c, p = staged(spark, d, asked)
    return retrieval.hybrid(p, c, work)


def _hits(work: Work, c: DataFrame, p: DataFrame) -> DataFrame:
    return work.table(retrieval.with_children(work.table(retrieval.hybrid(p, c, work), "found"), p, c), "hits")


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES) + "SELECT query_id, chunk_id, score::DOUBLE AS score, source::BIGINT AS source FROM cand")
def summary_children(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    """Hits together with, for broad queries, the three best children of the summaries among them."""
    return _hits(*staged(spark, d, asked))


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK) + "SELECT query_id, chunk_id, rerank_score::DOUBLE AS rerank_score, rank FROM rr")
def rerank_threshold(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    work, c, p = staged(spark, d, asked)
    return retrieval.rerank(_hits(work, c, p), p, c)


def _traversed(work: Work, c: DataFrame, p: DataFrame) -> DataFrame:
    return retrieval.traverse(work.table(retrieval.rerank(_hits(work, c, p), p, c), "reranked"), c)


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK, _TRAVERSE) + "SELECT query_id, chunk_id, rerank_score::DOUBLE AS rerank_score, fetched_as FROM tr")
def traverse_context(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    return _traversed(*staged(spark, d, asked))


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK, _TRAVERSE) + """SELECT mode, count(*) AS n_queries, sum(n_candidates)::BIGINT AS n_candidates, sum(n_reranked)::BIGINT AS n_reranked, sum(n_final)::BIGINT AS n_final FROM p
LEFT JOIN (SELECT query_id, count(*) AS n_candidates FROM cand GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n_reranked FROM rr GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n_final FROM tr GROUP BY 1) USING (query_id) GROUP BY mode""")
def retrieval_counters(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    """Candidates, re-ranked and final chunks per mode."""
    work, c, p = staged(spark, d, asked)
    cand = _hits(work, c, p)
    rr = work.table(retrieval.rerank(cand, p, c), "reranked")
    out = p.select("query_id", "mode")
    for name, df in (("n_candidates", cand), ("n_reranked", rr), ("n_final", retrieval.traverse(rr, c))):
        out = out.join(df.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left")
    return out.groupBy("mode").agg(F.count("*").alias("n_queries"), *[F.sum(n).alias(n) for n in ("n_candidates", "n_reranked", "n_final")])


_BUDGET = 1200
#: What a model's context holds, the tokens of the instruction, and those kept for the answer.
_LIMIT, _SYSTEM, _REPLY = 20_800, len("Answer from the sources below.") // 4, 1024


def _fill_sql(budget: str) -> str:
    return f"""o AS (SELECT t.query_id, t.chunk_id, CASE WHEN coalesce(c.token_count, 0) = 0 THEN {_tokens('c.text_for_display')} ELSE c.token_count END AS size, {budget} AS budget, c.chunk_sequence_index AS seq, c.level, c.section_title, c.text_for_display, c.equation_latex,
 row_number() OVER (PARTITION BY t.query_id ORDER BY fetched_as <> 'direct', NOT coalesce(c.is_key_section, false), -rerank_score, c.level <> 0, t.chunk_id) AS n FROM tr t JOIN cur c ON c.chunk_id = t.chunk_id JOIN p ON p.query_id = t.query_id),
fill AS (SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS used, []::VARCHAR[] AS ids FROM (SELECT DISTINCT query_id FROM o) UNION ALL
 SELECT f.query_id, f.n + 1, CASE WHEN f.used + o.size <= o.budget THEN f.used + o.size ELSE f.used END, CASE WHEN f.used + o.size <= o.budget THEN list_append(f.ids, o.chunk_id) ELSE f.ids END FROM fill f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1),
filled AS (SELECT query_id, used, ids, n - len(ids) AS dropped FROM fill QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1)"""


_FILL = _fill_sql(str(_BUDGET))


def _filled(work: Work, c: DataFrame, p: DataFrame, budget: Column | None = None) -> DataFrame:
    t = _traversed(work, c, p).join(c.select("chunk_id", "is_key_section", "level", "token_count", "text_for_display"), "chunk_id")
    t = t.join(p.select("query_id", (F.lit(_BUDGET) if budget is None else budget).alias("budget")), "query_id")
    size = F.when(F.coalesce("token_count", F.lit(0)) == 0, count_tokens(F.col("text_for_display"))).otherwise(F.col("token_count"))
    order = [F.col("fetched_as") != "direct", ~F.coalesce("is_key_section", F.lit(False)), -F.col("rerank_score"), F.col("level") != 0, F.col("chunk_id")]
    return retrieval.fill_budget(t, "query_id", order, size, F.col("chunk_id"), F.col("budget"))


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK, _TRAVERSE, _FILL).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT query_id, array_to_string(ids, ',') AS included, used, dropped FROM filled")
def context_budget_fill(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    """The chunks that fill each query's budget, taken in order of priority."""
    return _filled(*staged(spark, d, asked)).select("query_id", F.array_join("included", ",").alias("included"), "used", "dropped")


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK, _TRAVERSE, _FILL).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT query_id, md5(string_agg('--- ' || CASE level WHEN 1 THEN 'SECTION SUMMARY' WHEN 2 THEN 'GROUP SUMMARY' WHEN 3 THEN 'PAPER OVERVIEW' ELSE 'SOURCE' END || ': ' || coalesce(section_title, 'Unknown Section') || ' ---' || chr(10) || text_for_display
 || coalesce(array_to_string(list_transform(equation_latex, lambda e: chr(10) || 'Equation: $$' || e || '$$'), ''), ''), chr(10) || chr(10) ORDER BY seq, level, chunk_id)) AS context_hash, count(*) AS n_blocks, string_agg(DISTINCT section_title, '|' ORDER BY section_title) AS sections
FROM (SELECT f.query_id, unnest(ids) AS chunk_id FROM filled f) JOIN o USING (query_id, chunk_id) WHERE text_for_display <> '' GROUP BY 1""")
def context_text(spark: SparkSession, d: str, asked: str = _LEAVES) -> DataFrame:
    """The formatted context of each query, in reading order."""
    work, c, p = staged(spark, d, asked)
    rows = _filled(work, c, p).select("query_id", F.explode("included").alias("chunk_id")).join(c, "chunk_id").where("text_for_display <> ''")
    blocks = F.array_sort(F.collect_list(F.struct("chunk_sequence_index", "level", "chunk_id", retrieval.context_block().alias("block"))))
    return rows.groupBy("query_id").agg(
        F.md5(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n")).alias("context_hash"), F.count("*").alias("n_blocks"), F.array_join(F.sort_array(F.collect_set("section_title")), "|").alias("sections")
    )


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK, _TRAVERSE, _fill_sql(f"({_LIMIT - _SYSTEM - _REPLY} - ({_tokens('p.query_text')}))")).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT query_id, array_to_string(ids, ',') AS included, used, dropped FROM filled")
def context_budget_full(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that fill what each query leaves of a model's context: its limit without instruction, query and reply."""
    work, c, p = staged(spark, d)
    budget = F.lit(_LIMIT - _SYSTEM - _REPLY) - count_tokens(F.col("query_text"))
    return _filled(work, c, p, budget).select("query_id", F.array_join("included", ",").alias("included"), "used", "dropped")


_BLOCKS = """SELECT query_id, string_agg('--- ' || CASE level WHEN 1 THEN 'SECTION SUMMARY' WHEN 2 THEN 'GROUP SUMMARY' WHEN 3 THEN 'PAPER OVERVIEW' ELSE 'SOURCE' END || ': ' || coalesce(section_title, 'Unknown Section') || ' ---' || chr(10) || text_for_display
 || coalesce(array_to_string(list_transform(equation_latex, lambda e: chr(10) || 'Equation: $$' || e || '$$'), ''), ''), chr(10) || chr(10) ORDER BY seq, level, chunk_id) AS context FROM (SELECT f.query_id, unnest(ids) AS chunk_id FROM filled f) JOIN o USING (query_id, chunk_id) WHERE text_for_display <> '' GROUP BY 1"""


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK, _TRAVERSE, _FILL, f"b AS ({_BLOCKS})").replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT p.query_id, md5(coalesce(context[1:{retrieval.RAW_CHARS}], '{retrieval.NO_CONTEXT}')) AS answer_hash,
md5('Answer from the sources below.' || CASE WHEN table_signal THEN ' Tables are given as text.' ELSE '' END || CASE WHEN equation_signal THEN ' Equations are given in LaTeX.' ELSE '' END || CASE WHEN figure_signal THEN ' Figures are given by caption.' ELSE '' END || chr(10) || coalesce(context, '') || chr(10) || 'Question: ' || coalesce(query_text, '')) AS prompt_hash FROM p LEFT JOIN b ON b.query_id = p.query_id""")
def answer_rows(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each query with its retrieved context, and the answer where no model is plugged in."""
    work, c, p = staged(spark, d)
    rows = _filled(work, c, p).select("query_id", F.explode("included").alias("chunk_id")).join(c, "chunk_id").where("text_for_display <> ''")
    blocks = F.array_sort(F.collect_list(F.struct("chunk_sequence_index", "level", "chunk_id", retrieval.context_block().alias("block"))))
    contexts = work.table(rows.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context")), "contexts")
    note = lambda kind, words: F.when(F.col(f"{kind}_signal"), F.lit(words)).otherwise("")
    prompt = F.concat(
        F.lit("Answer from the sources below."),
        note("table", " Tables are given as text."),
        note("equation", " Equations are given in LaTeX."),
        note("figure", " Figures are given by caption."),
        F.lit("\n"),
        F.coalesce("context", F.lit("")),
        F.lit("\nQuestion: "),
        F.coalesce("query_text", F.lit("")),
    )
    prompts = p.join(contexts, "query_id", "left").select("query_id", F.md5(prompt).alias("prompt_hash"))
    return retrieval.answers(p, contexts).select("query_id", F.md5("answer").alias("answer_hash")).join(prompts, "query_id")


@query(_with(_CUR, _Q, _FALL, _DENSE, _SPARSE, _FUSED, _TOP, _CANDIDATES, _RERANK.replace("round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6)", "round(1 / (1 + exp(4 - 8 * (CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END))), 6)")) + "SELECT query_id, chunk_id, rerank_score::DOUBLE AS rerank_score, rank FROM rr")
def rerank_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    """Re-ranking by the sigmoid of a logit, here eight times the share of terms less four."""
    work, c, p = staged(spark, d)
    return retrieval.rerank(_hits(work, c, p), p, c, logit=lambda share: 8 * share - 4)


@query("SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS prompt_hash FROM (SELECT chunk_id AS query_id, 'Answer from the sources below.' || CASE WHEN has_table THEN ' Tables are given as text.' ELSE '' END || CASE WHEN has_equation THEN ' Equations are given in LaTeX.' ELSE '' END || CASE WHEN has_figure THEN ' Figures are given by caption.' ELSE '' END || chr(10) || 'Section: ' || coalesce(section_title, '') || chr(10) || coalesce(text_for_display, '') AS prompt FROM (WITH " + _CUR + " SELECT * FROM cur))")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for every chunk as its own context."""
    note = lambda flag, words: F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(words)).otherwise("")
    prompt = F.concat(
        F.lit("Answer from the sources below."),
        note("has_table", " Tables are given as text."),
        note("has_equation", " Equations are given in LaTeX."),
        note("has_figure", " Figures are given by caption."),
        F.lit("\nSection: "),
        F.coalesce("section_title", F.lit("")),
        F.lit("\n"),
        F.coalesce("text_for_display", F.lit("")),
    )
    return retrieval.newest(table(spark, d, "chunks"), columns=("chunk_id", *_COLUMNS)).select(F.col("chunk_id").alias("query_id"), F.length(prompt).alias("n_chars"), F.md5(prompt).alias("prompt_hash"))


def _on_all_levels(of):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return of.__wrapped__(spark, d, _ALL)

    run.__name__, run.__doc__ = f"{of.__name__}_all_levels", f"{of.__name__} with the chunks of every level as queries."
    return run


for _of in (dense_search, sparse_search, hybrid_rrf, hybrid_boosted, summary_children, rerank_threshold, traverse_context, retrieval_counters, context_budget_fill, context_text):
    query(SQL[_of.__name__].replace(_LEAVES, _ALL))(_on_all_levels(_of))
