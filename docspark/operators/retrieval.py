"""Hybrid retrieval for a batch of queries as one plan.

All steps take and return DataFrames keyed by ``query_id``: candidates of both
legs, rank fusion, boosts, re-ranking, expansion along the tree, and the fill of a
token budget. Ties are broken by chunk id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import vectors
from docspark.operators import knn
from docspark.work import Work

#: Rank constant of the fusion.
RRF = 60
#: Multipliers by level, for key sections and by importance.
LEVEL_BOOST = {1: 1.10, 2: 1.05, 3: 1.08}
KEY_BOOST, HIGH_BOOST, LOW_BOOST = 1.05, 1.05, 0.95


#: Modalities a query may ask for.
KINDS = ("table", "equation", "figure")
#: The plan of a broad query whose paper has no fitting summary.
FALLBACK = {"dense_weight": 0.5, "sparse_weight": 0.5, "top_k": 8, "least_level": 0, "most_level": 99}


def newest(rows: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the latest ingested (by the time meant, whatever its form and offset; unreadable ones come first); equal times are decided by the links, so that the choice is the same in every run."""
    keep = [c for c in (columns or rows.columns) if c != key]
    order = F.struct(F.try_to_timestamp(F.col("ingested_at").cast("string")).alias("at"), *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("children_ids", "parent_ids", "sibling_ids")])
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), order).alias("row"))
    return one.select(key, *[F.col(f"row.`{c}`").alias(c) for c in keep])


def rank_in(df: DataFrame, by: list[Column], k: Column | int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each query in the order ``by``."""
    w = Window.partitionBy("query_id").orderBy(*by)
    ranked = df.withColumn(name, F.row_number().over(w))
    return ranked.where(F.col(name) <= k)


def _allowed() -> Column:
    """Whether a chunk passes the plan's level and modality filters; several modalities must all hold."""
    level = F.col("level").between(F.col("least_level"), F.col("most_level"))
    kinds = [~F.col(f"{k}_signal") | F.coalesce(F.col(f"has_{k}"), F.lit(False)) for k in KINDS]
    return level & kinds[0] & kinds[1] & kinds[2]


_PLAN = ["query_id", "paper_id", "least_level", "most_level", "table_signal", "equation_signal", "figure_signal", "top_k"]


def dense_leg(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` by cosine within the query's paper; scores below 0 are cut."""
    flags = [F.coalesce(F.col(f"has_{k}"), F.lit(False)).cast("int") for k in KINDS]
    asked = [F.col(f"{k}_signal").cast("int") for k in KINDS]
    bits = lambda x: x[0] + 2 * x[1] + 4 * x[2]
    c = chunks.select(F.col("paper_id").alias("grp"), F.col("chunk_id").alias("id"), F.col("dense_vector").alias("vector"), F.coalesce("level", F.lit(-1)).alias("level"), bits(flags).alias("flags"))
    q = plans.select(F.col("paper_id").alias("grp"), F.col("query_id").alias("id"), F.col("dense_vector").alias("vector"), "least_level", "most_level", bits(asked).alias("flags"), "top_k")
    return rank_in(knn.top_within(q, c), [F.desc("score"), F.col("chunk_id")], F.col("top_k")).drop("top_k")


def sparse_leg(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same by the dot product over shared terms: a join on paper and term."""
    pairs = lambda df, *keep: df.where(F.size("sparse_indices") == F.size("sparse_values")).select(*keep, F.explode(F.arrays_zip("sparse_indices", "sparse_values")).alias("x"))
    c = pairs(chunks, "paper_id", "chunk_id", "level", "has_table", "has_equation", "has_figure").select("*", F.col("x.sparse_indices").alias("term"), F.col("x.sparse_values").alias("w")).drop("x")
    q = pairs(plans, *_PLAN).select("*", F.col("x.sparse_indices").alias("term"), F.col("x.sparse_values").alias("u")).drop("x")
    hits = q.join(c, ["paper_id", "term"]).where(_allowed()).groupBy("query_id", "chunk_id", "top_k").agg(F.round(F.sum(F.col("u") * F.col("w")), 6).alias("score"))
    return rank_in(hits, [F.desc("score"), F.col("chunk_id")], F.col("top_k")).drop("top_k")


def fuse(dense: DataFrame, sparse: DataFrame, plans: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: ``(query_id, chunk_id, score)``; a union and one aggregation instead of an outer join."""
    legs = dense.select("query_id", "chunk_id", "rank", F.lit("dense").alias("leg")).union(sparse.select("query_id", "chunk_id", "rank", F.lit("sparse")))
    weight = F.when(F.col("leg") == "dense", F.col("dense_weight")).otherwise(F.col("sparse_weight"))
    weighed = legs.join(plans.select("query_id", "dense_weight", "sparse_weight"), "query_id")
    return weighed.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (RRF + F.col("rank"))), 9).alias("score"))


def boost() -> Column:
    """The multiplier of a chunk's level, key section and importance."""
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in LEVEL_BOOST.items() for x in kv])[F.col("level")], F.lit(1.0))
    key = F.when(F.coalesce(F.col("is_key_section"), F.lit(False)), F.lit(KEY_BOOST)).otherwise(1.0)
    weight = F.when(F.col("section_importance") == "high", F.lit(HIGH_BOOST)).when(F.col("section_importance") == "low", F.lit(LOW_BOOST)).otherwise(1.0)
    return level * key * weight


def search(plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` of both legs fused, boosted where the plan says so, and cut."""
    fused = fuse(dense_leg(plans, chunks), sparse_leg(plans, chunks), plans)
    known = fused.join(chunks.select("chunk_id", "level", "is_key_section", "section_importance"), "chunk_id").join(plans.select("query_id", "boosted", "top_k"), "query_id")
    scored = known.select("query_id", "chunk_id", "top_k", F.round(F.col("score") * F.when(F.col("boosted"), boost()).otherwise(1.0), 9).alias("score"))
    return rank_in(scored, [F.desc("score"), F.col("chunk_id")], F.col("top_k")).drop("top_k")


def hybrid(plans: DataFrame, chunks: DataFrame, work: Work) -> DataFrame:
    """:func:`search`; a broad query (mode B) that finds no summary is searched once more, over all levels and with the plan :data:`FALLBACK`."""
    hits = work.table(search(plans, chunks), "first")
    none = plans.where("mode = 'B'").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    kinds = dict(plans.dtypes)
    if not none.limit(1).count():
        return hits
    again = work.table(none.select(*[F.lit(FALLBACK[c]).cast(kinds[c]).alias(c) if c in FALLBACK else F.col(c) for c in plans.columns]), "broad")
    return hits.unionByName(search(again, chunks))


def best_children(summaries: DataFrame, chunks: DataFrame, n: int, default: float) -> DataFrame:
    """``(query_id, summary_id, chunk_id, membership, place)``: of each summary the ``n`` children that belong most to its cluster, ties in list order."""
    s = summaries.select("query_id", F.col("chunk_id").alias("summary_id"), F.try_element_at("cluster_ids", F.lit(1)).cast("string").alias("cluster"), F.posexplode("children_ids").alias("pos", "chunk_id"))
    c = chunks.select("chunk_id", F.col("cluster_probabilities").alias("p"))
    ranked = s.join(c, "chunk_id").withColumn("membership", F.coalesce(F.try_element_at("p", "cluster"), F.lit(default)))
    w = Window.partitionBy("query_id", "summary_id").orderBy(F.desc("membership"), "pos", "chunk_id")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "summary_id", "chunk_id", "membership", "place")


def with_children(hits: DataFrame, plans: DataFrame, chunks: DataFrame, n: int = 3, score: float = 0.5) -> DataFrame:
    """Hits and, for broad queries (mode B), the best children of those that are summaries, each chunk once (hits first)."""
    broad = hits.join(plans.where("mode = 'B'").select("query_id"), "query_id", "left_semi")
    known = broad.join(chunks.select("chunk_id", "level", "cluster_ids", "children_ids"), "chunk_id")
    kids = best_children(known.where("level >= 1"), chunks, n, 0.0).select("query_id", "chunk_id", F.lit(score).alias("score"), F.lit(1).alias("source")).distinct()
    both = hits.select("query_id", "chunk_id", "score", F.lit(0).alias("source")).union(kids)
    return both.groupBy("query_id", "chunk_id").agg(F.min_by("score", "source").alias("score"), F.min("source").alias("source"))


def rerank(hits: DataFrame, plans: DataFrame, chunks: DataFrame, threshold: float = 0.25, logit: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(query_id, chunk_id, rerank_score, rank)``: by the share of the query's terms in the chunk, cut at the threshold and the plan's number; the best one if none passes.

    ``logit`` turns the share into a logit whose sigmoid is the score, as a cross-encoder's output would be.
    """
    q = plans.select("query_id", "rerank_n", F.array_distinct(vectors.terms(F.col("query_text"))).alias("q"))
    c = chunks.select("chunk_id", F.array_distinct(vectors.terms(F.col("text_for_display"))).alias("c"))
    share = F.when(F.size("q") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("q", "c")) / F.size("q"))
    score = share if logit is None else vectors.sigmoid(logit(share))
    scored = hits.join(q, "query_id").join(c, "chunk_id").select("query_id", "chunk_id", "rerank_n", F.round(score, 6).alias("rerank_score"))
    ranked = rank_in(scored, [F.desc("rerank_score"), F.col("chunk_id")], F.col("rerank_n"))
    return ranked.where((F.col("rerank_score") >= threshold) | (F.col("rank") == 1)).drop("rerank_n")


def traverse(reranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, rerank_score, fetched_as)``: hits, the first parent of each leaf, the two best children of each summary; each chunk once."""
    known = reranked.join(chunks.select("chunk_id", "level", "parent_ids", "cluster_ids", "children_ids"), "chunk_id")
    up = known.where("level = 0").select("query_id", F.col("rerank_score").alias("s"), F.try_element_at("parent_ids", F.lit(1)).alias("chunk_id"))
    parents = up.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", F.round(F.col("s") * 0.8, 6).alias("rerank_score"), F.lit("traversal_parent").alias("fetched_as"), F.lit(1).alias("source"))
    summaries = known.where("level >= 1")
    down = best_children(summaries, chunks, 2, 0.1).join(summaries.select("query_id", F.col("chunk_id").alias("summary_id"), F.col("rerank_score").alias("s")), ["query_id", "summary_id"])
    kids = down.select("query_id", "chunk_id", F.round(F.col("membership") * F.col("s"), 6).alias("rerank_score"), F.lit("traversal_child").alias("fetched_as"), F.lit(2).alias("source"))
    direct = reranked.select("query_id", "chunk_id", "rerank_score", F.lit("direct").alias("fetched_as"), F.lit(0).alias("source"))
    first = F.struct("source", -F.col("rerank_score"))
    return direct.union(parents).union(kids).groupBy("query_id", "chunk_id").agg(F.min_by("rerank_score", first).alias("rerank_score"), F.min_by("fetched_as", first).alias("fetched_as"))


def fill_budget(rows: DataFrame, key: str, order: list[Column], size: Column, item: Column, budget: int | Column) -> DataFrame:
    """``(key, included, used, dropped)``: items in order, each taken if it still fits, skipped otherwise (later ones may fit).

    A fold over one group's bounded list of candidates; ``order`` holds sortable columns, ascending; ``budget`` is one
    for all or a column that is the same in a group.
    """
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], size.cast("bigint").alias("size"), item.alias("item")))).alias("all"), F.first(budget if isinstance(budget, Column) else F.lit(budget)).cast("bigint").alias("budget"))
    empty = F.array().cast(f"array<{rows.select(item).schema[0].dataType.simpleString()}>")
    state = F.aggregate(
        "all",
        F.struct(empty.alias("included"), F.lit(0).cast("bigint").alias("used")),
        lambda acc, x: F.when(
            acc["used"] + x["size"] <= F.col("budget"), F.struct(F.concat(acc["included"], F.array(x["item"])).alias("included"), (acc["used"] + x["size"]).alias("used"))
        ).otherwise(acc),
    )
    return listed.select(key, F.size("all").alias("n"), state.alias("s")).select(key, F.col("s.included").alias("included"), F.col("s.used").alias("used"), (F.col("n") - F.size("s.included")).alias("dropped"))


def context_block() -> Column:
    """A chunk's labelled block of text with its equations."""
    label = F.coalesce(F.create_map(*[F.lit(x) for x in (0, "SOURCE", 1, "SECTION SUMMARY", 2, "GROUP SUMMARY", 3, "PAPER OVERVIEW")])[F.col("level")], F.lit("SOURCE"))
    lines = F.transform(F.coalesce("equation_latex", F.array().cast("array<string>")), lambda e: F.concat(F.lit("\nEquation: $$"), e, F.lit("$$")))
    return F.concat(F.lit("--- "), label, F.lit(": "), F.coalesce("section_title", F.lit("Unknown Section")), F.lit(" ---\n"), F.col("text_for_display"), F.array_join(lines, ""))


NO_CONTEXT, RAW_CHARS = "Nothing in this paper answers the question.", 2000


def answers(plans: DataFrame, contexts: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(query_id, answer)`` from ``contexts(query_id, context)``: ``model`` answers ``(query_id, query_text, context)`` rows with ``(query_id, answer)``.

    A query without context gets :data:`NO_CONTEXT`; one the model leaves out (or all, where none is given) gets the first 2,000 characters of its context.
    """
    asked = plans.select("query_id", "query_text").join(contexts, "query_id", "left")
    told = model(asked.where("context is not null")).select("query_id", F.col("answer").alias("_told")) if model else None
    both = asked.join(told, "query_id", "left") if told is not None else asked.withColumn("_told", F.lit(None).cast("string"))
    return both.select("query_id", F.coalesce("_told", F.substring("context", 1, RAW_CHARS), F.lit(NO_CONTEXT)).alias("answer"))
