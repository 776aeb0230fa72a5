"""Queries of the operators of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import clusters, conversations, lookalike, mixing, near_duplicates, packing, split, tokens
from docspark.llm.pairs import pairs_within
from docspark.sources.tables import table
from docspark.work import Work


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), F.col("text_for_embedding").alias("text"))
    elements = table(spark, d, "elements").select(F.lit("elements").alias("item_table"), F.col("element_id").alias("item_id"), F.col("content.raw").alias("text"))
    return split.split_oversized(chunks.unionByName(elements))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Items above 500 tokens: those that come out in more than one piece."""
    return _pieces(spark, d).where("piece_no = 1").select("item_table", "item_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pieces of every item above 500 tokens."""
    return _pieces(spark, d)


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Every item above 500 tokens: the hash of the text its pieces give again, and how many pieces are too long or repeat too much."""
    pieces = _pieces(spark, d)
    new = F.struct("piece_no", F.substr("text", F.col("overlap") + 1).alias("t"))
    whole = pieces.groupBy("item_table", "item_id", "digest").agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(new))["t"], "")).alias("text_hash"), F.count_if(F.length("text") >= 4 * (split.LIMIT_TOKENS + 1)).alias("n_too_long"), F.count_if(F.col("overlap") > 4 * split.OVERLAP_TOKENS).alias("n_repeat_too_much")
    )
    return whole.drop("digest")


def _passages(spark: SparkSession, d: str, work: Work) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("text_for_embedding").alias("text"))
    return near_duplicates.near_duplicate_classes(chunks, work, n=3, similarity=0.6, least_words=20)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose passages are tied directly or through a chain."""
    work = Work(spark, "p3")
    classes = work.table(_passages(spark, d, work), "classes")
    sizes = classes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    members = classes.join(sizes, "class").withColumnRenamed("id", "chunk_id")
    return pairs_within(members, "class", "chunk_id").select("chunk_id_a", "chunk_id_b").distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the smallest chunk_id of its class of near-duplicates and the class's size."""
    work = Work(spark, "p3")
    classes = work.table(_passages(spark, d, work), "classes")
    sizes = classes.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n_members"))
    return classes.join(sizes, "class").select(F.col("id").alias("chunk_id"), "class_id", "n_members")


def _clusters(spark: SparkSession, d: str, work: Work) -> DataFrame:
    rows = table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("dense_vector").alias("vector"))
    return work.table(clusters.similarity_clusters(rows, work), "clusters")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the clusters of 3 or more chunks."""
    found = _clusters(spark, d, Work(spark, "p4")).select("cluster_key", F.col("id").alias("chunk_id")).distinct()
    large = found.groupBy("cluster_key").agg(F.count("*").alias("n")).where("n >= 3").select("cluster_key")
    return found.join(large, "cluster_key")


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster, single chunks included, and its number of members."""
    found = _clusters(spark, d, Work(spark, "p4")).select("cluster_key", F.col("id").alias("chunk_id")).distinct()
    return found.groupBy("cluster_key").agg(F.count("*").alias("n_members"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size and most typical members."""
    return clusters.describe(_clusters(spark, d, Work(spark, "p4"))).withColumn("typical", F.array_join("typical", ","))


def _conversations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    messages, sessions, aliases = (table(spark, d, t) for t in ("chat_messages", "chat_sessions", "role_aliases"))
    return conversations.rebuild(messages, sessions, aliases, Work(spark, "p5"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose conversation is broken, empty or lacks replies."""
    return _conversations(spark, d)[0].where("reason is not null").select("session_id")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The ordered messages of the sessions kept; the time of creation in microseconds."""
    told = _conversations(spark, d)[1]
    return told.select("session_id", "position", "id", "role", "content", F.unix_micros("created_at").alias("created_us"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    work = Work(spark, "p7")
    sizes = work.table(tokens.token_sizes(table(spark, d, "documents")).select("doc_id", "tokens"), "sizes")
    return packing.pack(sizes, table(spark, d, "pack_profiles"), work)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document (or part of one above the capacity), for each capacity."""
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers needed and share of their capacity used, for each capacity."""
    return packing.fill_report(_packed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for each capacity: every document with a text is placed, no container is over its capacity, no document that fits is cut, no token is lost."""
    work = Work(spark, "p7")
    sizes = work.table(tokens.token_sizes(table(spark, d, "documents")).select("doc_id", "tokens"), "sizes")
    packed = work.table(packing.pack(sizes, table(spark, d, "pack_profiles"), work), "packed")
    full = packed.groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("tokens")).groupBy("profile").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("n_over"))
    docs = packed.groupBy("profile", "capacity", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("parts"))
    held = docs.join(sizes.where("tokens > 0"), "doc_id", "full")
    whole = held.groupBy("profile").agg(
        F.count("*").alias("n_documents"), F.count_if((F.col("tokens") <= F.col("capacity")) & (F.col("parts") > 1)).alias("n_cut"), F.sum(F.abs(F.coalesce("placed", F.lit(0)) - F.coalesce("tokens", F.lit(0)))).alias("n_lost")
    )
    return whole.join(full, "profile").select("profile", "n_documents", "n_over", "n_cut", "n_lost")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    work = Work(spark, "p8")
    sizes = work.table(tokens.token_sizes(table(spark, d, "documents")), "sizes")
    return mixing.mix(sizes, table(spark, d, "mix_targets"), work)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixed(spark, d)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every target: no document beyond its repeats, none of another source, a share within a document or so of the one wanted."""
    chosen, report = _mixed(spark, d)
    own = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.max("tokens").alias("largest"))
    listed = report.join(own, "source", "full")
    sums = listed.agg(F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).alias("whole"), F.sum("used_tokens").alias("all_tokens"), F.max("largest").alias("any"))
    near = F.abs(F.col("used_tokens") - F.when(F.col("available_tokens") > 0, F.col("target_share") / F.col("whole") * F.col("all_tokens")).otherwise(0)) <= 9 * F.col("any") + 9
    out = listed.join(F.broadcast(sums), how="cross")  # a single row
    return out.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), F.coalesce(near, F.lit(True)).alias("near_target"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return Work(spark, "p9").table(lookalike.canonical_texts(table(spark, d, "documents")), "canonical")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that look the same and are written with different characters."""
    return lookalike.equal_looking_pairs(_canonical(spark, d))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the smallest id that looks the same, and the size of its class."""
    return lookalike.equal_looking_classes(_canonical(spark, d))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's one consistent text."""
    return lookalike.canonical_texts(table(spark, d, "documents")).select("doc_id", "canonical", (F.md5("canonical") != F.col("digest")).alias("changed"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_check, p3_found, p3_classes, p4_found, p4_sizes, p4_clusters, p5_found, p5_conversations, p7_packing, p7_fill, p7_check, p8_mix, p8_shares, p8_check, p9_found, p9_classes, p9_canonical)}
