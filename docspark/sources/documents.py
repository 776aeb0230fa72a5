"""Parsed documents as JSON: one file per paper, many papers in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A parsed document; fields that are absent are null, a field of the wrong type fails the read.
SCHEMA = """document struct<paper_id:string,paper_title:string,authors:array<string>,year:int,total_pages:int,total_elements:int,language:string,parsed_at:string,parser_version:string,source_pdf:string,assets_dir:string>,
elements array<struct<element_id:string,type:string,
location:struct<page_no:int,order:int,bbox:map<string,double>>,
section:struct<title:string,hierarchy:array<string>,is_key_section:boolean,section_index:int,section_importance:string,retrieval_boost:double,heading_level:int,is_section_boundary:boolean>,
content:struct<raw:string,token_count:int,caption:string,header_row:array<string>,rows:array<map<string,string>>,has_formula_cells:boolean,image_path:string,latex_raw:string,latex_clean:string,latex_confidence:double,natural_language_description:string,equation_number:string,extracted_variables:string>,
references:struct<cites_equations:array<string>,cites_tables:array<string>,cites_figures:array<string>,referenced_by_elements:array<string>>,
surrounding_context:struct<preceding_element_id:string,following_element_id:string,preceding_text:string,following_text:string,context_window_text:string>,
phase2_ready:struct<action:string,text_for_embedding:string,text_for_display:string,embedding_strategy:string,embedding_notes:string,image_path_for_vlm:string,latex_for_llm:string,note:string>,
adjacency:struct<prev_element_id:string,next_element_id:string,prev_type:string,next_type:string>>>"""


class DocumentFormatError(ValueError):
    """A document is missing, no JSON, or not of :data:`SCHEMA`."""


def read_documents(spark: SparkSession, path: str, pattern: str = "*/elements.json") -> DataFrame:
    """``(file, document, elements)`` of every file under ``path`` that matches. Malformed files fail the job that reads them; a missing path raises at once."""
    try:
        read = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(f"{path.rstrip('/')}/{pattern}" if pattern else path)
    except Exception as e:
        raise DocumentFormatError(f"cannot read {path}: {e}") from e
    return read.select(F.col("_metadata.file_path").alias("file"), "document", "elements")


def elements_of(documents: DataFrame) -> DataFrame:
    """One row per element with its paper; the list's order replaces a missing one. Documents without elements give none."""
    rows = documents.select(F.col("document.paper_id").alias("paper_id"), F.to_timestamp("document.parsed_at").alias("parsed_at"), F.posexplode("elements").alias("at", "e"))
    placed = F.struct(F.col("e.location.page_no").alias("page_no"), F.coalesce("e.location.order", "at").alias("order"), F.col("e.location.bbox").alias("bbox"))
    return rows.select("paper_id", "parsed_at", "e.element_id", "e.type", placed.alias("location"), "e.section", "e.content", "e.references", "e.surrounding_context", "e.phase2_ready", "e.adjacency")
