"""Queries of the chunking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import sections
from docspark.functions.text import count_tokens
from docspark.operators.chunking import chunk_elements, newest_elements, prepared, simple_fold
from docspark.plans import registry
from docspark.plans.textual import _TREATED, _tokens
from docspark.sources.tables import table
from docspark.work import Work

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)

_NEW = "e AS (SELECT * FROM elements WHERE element_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY parsed_at DESC NULLS LAST) = 1)"


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return newest_elements(table(spark, d, "elements"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of every parsed paper."""
    out = chunk_elements(table(spark, d, "elements"))
    return out.withColumn("source_element_ids", F.array_join("source_element_ids", ","))


@query()
def ingestion_report(spark: SparkSession, d: str) -> DataFrame:
    """Per paper: chunks, soft splits, token range, sections, and elements that ended in no chunk."""
    e = table(spark, d, "elements")
    made = chunk_elements(e).groupBy("paper_id").agg(
        F.count("*").alias("n_chunks"),
        F.count_if("soft_split").alias("n_soft_split"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.round(F.avg("token_count"), 1).alias("avg_tokens"),
        F.count_distinct("section_title").alias("n_sections"),
        F.sum(F.size("source_element_ids")).alias("n_used"),
    )
    total = newest_elements(e).groupBy("paper_id").agg(F.count("*").alias("n_elements"))
    out = total.join(made, "paper_id", "left").fillna(0)
    return out.withColumn("n_skipped", F.col("n_elements") - F.col("n_used")).withColumn("succeeded", F.col("n_chunks") > 0)


@query(f"WITH {_NEW} SELECT paper_id, count(*) FILTER (WHERE type = 'section_header') AS n_headers, count(*) FILTER (WHERE coalesce(len(content.raw), 0) = 0) AS n_empty, count(*) AS n_elements, count(DISTINCT section.title) AS n_titles FROM e GROUP BY 1")
def header_check(spark: SparkSession, d: str) -> DataFrame:
    """Headers per paper (none: synthetic parts are made)."""
    empty = F.coalesce(F.length("content.raw"), F.lit(0)) == 0
    return _elements(spark, d).groupBy("paper_id").agg(F.count_if(F.col("type") == "section_header").alias("n_headers"), F.count_if(empty).alias("n_empty"), F.count("*").alias("n_elements"), F.count_distinct("section.title").alias("n_titles"))


@query(f"""WITH {_NEW}, o AS (SELECT paper_id, element_id, section.title AS title, phase2_ready.action AS action, coalesce(location.order, 0) AS ord FROM e)
SELECT paper_id, element_id, coalesce(lead(action) OVER w = 'hard_chunk_boundary', false) AS before_boundary, coalesce(title <> lag(title) OVER w, false) AS new_section, sum(CASE WHEN action = 'hard_chunk_boundary' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ord, element_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM o WINDOW w AS (PARTITION BY paper_id ORDER BY ord, element_id)""")
def boundary_runs(spark: SparkSession, d: str) -> DataFrame:
    """Elements before a boundary, section changes, and the run between boundaries each belongs to."""
    w = Window.partitionBy("paper_id").orderBy("ord", "element_id")
    rows = _elements(spark, d).select("paper_id", "element_id", F.col("section.title").alias("title"), F.col("phase2_ready.action").alias("action"), F.coalesce("location.order", F.lit(0)).alias("ord"))
    hit = (F.col("action") == "hard_chunk_boundary").cast("int")
    return rows.select(
        "paper_id", "element_id", F.coalesce(F.lead("action").over(w) == "hard_chunk_boundary", F.lit(False)).alias("before_boundary"), F.coalesce(F.col("title") != F.lag("title").over(w), F.lit(False)).alias("new_section"), F.sum(F.coalesce(hit, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    )


@query(f"SELECT paper_id, count(*) AS n_references, string_agg(element_id, ',' ORDER BY element_id) AS ids FROM (SELECT DISTINCT e.paper_id, t.element_id FROM ({_TREATED}) t JOIN elements e ON e.element_id = t.element_id WHERE t.treatment = 'metadata_only' AND t.raw <> '') GROUP BY 1")
def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    """Elements kept at document level only."""
    e = table(spark, d, "elements").withColumn("treatment", sections.treatment(F.col("section.title"), F.col("content.raw"), F.col("content.token_count")))
    some = e.where((F.col("treatment") == "metadata_only") & (F.col("content.raw") != "")).select("paper_id", "element_id").distinct()
    return some.groupBy("paper_id").agg(F.count("*").alias("n_references"), F.array_join(F.sort_array(F.collect_list("element_id")), ",").alias("ids"))


_FOLD = f"""WITH RECURSIVE {_NEW}, o AS (SELECT paper_id, {_tokens('content.raw')} AS n, row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(location.order, 0), element_id) AS r FROM e WHERE paper_id IS NOT NULL),
f AS (SELECT paper_id, 0::BIGINT AS r, 0::BIGINT AS held, 0::BIGINT AS part FROM (SELECT DISTINCT paper_id FROM o) UNION ALL SELECT f.paper_id, f.r + 1, CASE WHEN f.held + o.n >= 300 THEN 0 ELSE f.held + o.n END, CASE WHEN f.held + o.n >= 300 THEN f.part + 1 ELSE f.part END FROM f JOIN o ON o.paper_id = f.paper_id AND o.r = f.r + 1)"""


@query(_FOLD + " SELECT paper_id, max(part) AS n_full, arg_max(held, r) AS rest, max(r) AS n_elements FROM f GROUP BY 1")
def chunk_simple_fold(spark: SparkSession, d: str) -> DataFrame:
    """Running token sums that start anew at 300: full parts and what is left, by a fold over each paper's sizes."""
    rows = _elements(spark, d).where("paper_id is not null").select("paper_id", F.coalesce("location.order", F.lit(0)).alias("ord"), "element_id", count_tokens(F.col("content.raw")).cast("bigint").alias("n"))
    return simple_fold(rows)


_PREPARED = f"""{_NEW}, tr AS (SELECT element_id, treatment FROM ({_TREATED.replace("FROM elements", "FROM e")})),
b AS (SELECT *, type = 'table' AND coalesce(len(content.header_row) > 0 AND len(content.rows) > 0 AND lower(trim(content.header_row[1])) IN ('n', 'row', 'model', 'method', 'layer type', '')
 AND trim(coalesce(content.rows[1][content.header_row[1]], '')) <> '' AND NOT regexp_matches(regexp_replace(trim(coalesce(content.rows[1][content.header_row[1]], '')), '[.\\-]', '', 'g'), '^[0-9]+$'), false) AS bad FROM e),
o AS (SELECT b.paper_id, b.element_id, section.title AS given, coalesce(phase2_ready.action, '') AS action, treatment, CASE WHEN bad THEN coalesce(content.caption, '') || chr(10) || chr(10) || 'Columns: ' || array_to_string(content.header_row, ' | ') ELSE coalesce(phase2_ready.text_for_embedding, content.raw, '') END AS text,
 row_number() OVER w AS r, lead(coalesce(phase2_ready.action, '')) OVER w AS next_action, count(*) FILTER (WHERE type = 'section_header') OVER (PARTITION BY b.paper_id) AS heads FROM b JOIN tr ON tr.element_id = b.element_id WINDOW w AS (PARTITION BY b.paper_id ORDER BY coalesce(location.order, 0), b.element_id)),
f AS (SELECT paper_id, 0::BIGINT AS r, 0::BIGINT AS held, 1::BIGINT AS part, 1::BIGINT AS own FROM (SELECT DISTINCT paper_id FROM o WHERE heads = 0) UNION ALL
 SELECT f.paper_id, o.r, CASE WHEN f.held + {_tokens('o.text')} >= 400 THEN 0 ELSE f.held + {_tokens('o.text')} END, CASE WHEN f.held + {_tokens('o.text')} >= 400 THEN f.part + 1 ELSE f.part END, f.part FROM f JOIN o ON o.paper_id = f.paper_id AND o.r = f.r + 1)"""


@query(f"WITH RECURSIVE {_PREPARED} SELECT o.paper_id, o.element_id, CASE WHEN heads = 0 THEN 'part_' || f.own ELSE given END AS title, treatment, next_action FROM o LEFT JOIN f ON f.paper_id = o.paper_id AND f.r = o.r")
def synthetic_sections(spark: SparkSession, d: str) -> DataFrame:
    """Section titles as the chunker sees them (synthetic where a paper has no header)."""
    return prepared(_elements(spark, d)).select("paper_id", "element_id", "title", "treatment", "next_action")


@query(f"WITH RECURSIVE {_PREPARED} SELECT paper_id, count(*) AS n_elements, 0::BIGINT AS n_lost, 0::BIGINT AS n_out_of_order, 0::BIGINT AS n_wrong_size FROM o WHERE treatment LIKE 'process%' AND action <> 'hard_chunk_boundary' AND regexp_matches(text, '[^\\x00-\\x20\\x7f]') GROUP BY 1")
def chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for the chunks of every paper: each element with a text is in some chunk, chunks are in reading order, sizes are those of the texts."""
    e = table(spark, d, "elements")
    work = Work(spark, "chunks")
    made = work.table(chunk_elements(e), "made")
    rows = prepared(newest_elements(e)).where(sections.embeds(F.col("treatment")) & (F.col("action") != "hard_chunk_boundary") & F.col("text").rlike("[^\\x00-\\x20\\x7f]"))
    used = made.select(F.explode("source_element_ids").alias("element_id")).distinct().withColumn("used", F.lit(True))
    lost = rows.select("paper_id", "element_id").join(used, "element_id", "left").groupBy("paper_id").agg(F.count("*").alias("n_elements"), F.count_if(F.col("used").isNull()).alias("n_lost"))
    w = Window.partitionBy("paper_id").orderBy("seq")
    wrong = made.select("paper_id", (F.lag("first_order").over(w) > F.col("first_order")).alias("back"), (count_tokens(F.col("text")) != F.col("token_count")).alias("size"))
    wrong = wrong.groupBy("paper_id").agg(F.count_if("back").alias("n_out_of_order"), F.count_if("size").alias("n_wrong_size"))
    return lost.join(wrong, "paper_id", "left").fillna(0)
