"""Queries of the text and section functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import sections, signals, text, vectors
from docspark.plans import registry
from docspark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


query = registry(QUERIES, SQL)


_W = text.BLANK


def _tokens(t: str) -> str:
    return f"CASE WHEN coalesce(length({t}), 0) = 0 THEN 0 ELSE greatest(1, length({t}) // 4) END"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def _clean(t: str) -> str:
    s = f"regexp_replace({t}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"
    return _strip(f"regexp_replace(regexp_replace({s}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _title(t: str) -> str:
    return f"lower({_strip(f"regexp_replace({t}, '^[0-9]+[.0-9]*\\s*', '')")})"


def _sentences(t: str) -> str:
    cut = f"string_split(regexp_replace({t}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_strip('s')}), lambda s: s <> '')"


@query(f"""SELECT source, count(*) AS n_documents, min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 1) AS avg_tokens, sum(n)::BIGINT AS tokens,
count(DISTINCT h) AS n_texts, count(DISTINCT section_title) AS n_sections, count(*) FILTER (WHERE n > 500) AS n_oversize
FROM (SELECT source, section_title, {_tokens('text')} AS n, sha256(text) AS h FROM documents) GROUP BY source""")
def doc_chunk_report(spark: SparkSession, d: str) -> DataFrame:
    """Token counts, distinct texts and sections per source."""
    docs = table(spark, d, "documents").select("source", "section_title", text.count_tokens(F.col("text")).alias("n"), text.hash_text(F.col("text")).alias("h"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.round(F.avg("n"), 1).alias("avg_tokens"),
        F.sum("n").alias("tokens"),
        F.count_distinct("h").alias("n_texts"),
        F.count_distinct("section_title").alias("n_sections"),
        F.count_if(F.col("n") > 500).alias("n_oversize"),
    )


@query(f"SELECT doc_id, sha256({_clean('text')}) AS clean_hash, coalesce(length({_clean('text')}), -1)::BIGINT AS clean_chars FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    t = text.clean_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.hash_text(t).alias("clean_hash"), F.coalesce(F.length(t), F.lit(-1)).alias("clean_chars"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]+\.?[0-9]*\b'))), ' ') AS numbers FROM documents WHERE text IS NOT NULL""")
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.sort_array(text.extract_numbers(F.col("text"))), " ").alias("numbers"))


@query(f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(2))) AS sentences_hash FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL)")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = text.split_sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "\x02")).alias("sentences_hash"))


@query(f"""WITH s AS (SELECT doc_id, text, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, text, {_sentences('text[1:1500]')} AS s FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS reach FROM s), m AS (SELECT doc_id, max(reach) AS reach FROM c WHERE reach <= 1350 GROUP BY 1)
SELECT d.doc_id, CASE WHEN length(text) <= 1200 THEN length(text) ELSE coalesce(m.reach, -1) END::BIGINT AS boundary FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id WHERE text IS NOT NULL""")
def sentence_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Where each document would be cut near 300 tokens."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.sentence_boundary(F.col("text"), 300).alias("boundary"))


@query(f"SELECT {_title('section_title')} AS title, count(*) AS n_chunks, count(DISTINCT section_title) AS n_spellings FROM chunks GROUP BY 1")
def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy(text.normalize_title(F.col("section_title")).alias("title")).agg(F.count("*").alias("n_chunks"), F.count_distinct("section_title").alias("n_spellings"))


def _prefix(words: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(t, '{w}')" for w in words) + ")"


_ELEMENTS = f"""SELECT element_id, type, content.raw AS raw, coalesce({_title('section.title')}, '') AS t,
CASE WHEN content.raw IS NULL OR content.raw = '' THEN 'text'
 WHEN lower(regexp_extract({_strip('content.raw')}, '^(\\S*)', 1)) IN ({", ".join(f"'{w}'" for w in sections.ACKNOWLEDGEMENT)}) THEN 'acknowledgement'
 WHEN regexp_matches({_strip('content.raw')}, '^\\s*[0-9]+\\s+[A-Z]') AND coalesce(content.token_count, 0) < 60 THEN 'footnote' ELSE 'text' END AS subtype FROM elements"""
_TREATED = f"""SELECT *, CASE WHEN subtype = 'acknowledgement' THEN 'skip' WHEN t IN ('references', 'bibliography') THEN 'metadata_only'
 WHEN {_prefix(sections.SKIP)} THEN 'skip' WHEN {_prefix(sections.HIGH)} THEN 'process_high' WHEN {_prefix(sections.LOW)} THEN 'process_low' ELSE 'process_medium' END AS treatment FROM ({_ELEMENTS})"""


def _treated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "elements")
    return e.withColumn("treatment", sections.treatment(F.col("section.title"), F.col("content.raw"), F.col("content.token_count")))


@query(f"""SELECT element_id, subtype, treatment, treatment LIKE 'process%' AS embeds,
CASE treatment WHEN 'process_high' THEN 'high' WHEN 'process_medium' THEN 'medium' ELSE 'low' END AS importance,
CASE treatment WHEN 'process_high' THEN 1.1 WHEN 'process_medium' THEN 1.0 WHEN 'process_low' THEN 0.95 ELSE 0 END::DOUBLE AS boost,
CASE WHEN type = 'table' THEN 'table,specific' WHEN type = 'equation' THEN 'equation,specific' WHEN type = 'figure' THEN 'figure'
 WHEN treatment = 'process_high' AND NOT ({" OR ".join(f"contains(t, '{w}')" for w in sections.BROAD)}) THEN 'specific' ELSE 'broad' END AS affinities
FROM ({_TREATED})""")
def element_treatment(spark: SparkSession, d: str) -> DataFrame:
    """Subtype, treatment, importance, boost and affinity tags of every element row."""
    t = F.col("treatment")
    return _treated(spark, d).select(
        "element_id",
        sections.subtype(F.col("content.raw"), F.col("content.token_count")).alias("subtype"),
        "treatment",
        sections.embeds(t).alias("embeds"),
        sections.importance(t).alias("importance"),
        sections.boost(t).alias("boost"),
        F.array_join(sections.affinities(F.col("type"), F.col("section.title"), t), ",").alias("affinities"),
    )


@query(r"""SELECT element_id, CASE WHEN bad THEN coalesce(caption, '') || chr(10) || chr(10) || 'Columns: ' || array_to_string(header_row, ' | ') ELSE raw END AS text, bad AS misaligned FROM (
SELECT element_id, content.caption AS caption, content.header_row AS header_row, content.raw AS raw,
coalesce(len(content.header_row) > 0 AND len(content.rows) > 0 AND lower(trim(content.header_row[1])) IN ('n', 'row', 'model', 'method', 'layer type', '')
 AND trim(coalesce(content.rows[1][content.header_row[1]], '')) <> '' AND NOT regexp_matches(regexp_replace(trim(coalesce(content.rows[1][content.header_row[1]], '')), '[.\-]', '', 'g'), '^[0-9]+$'), false) AS bad
FROM elements WHERE type = 'table')""")
def table_misalignment(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose first column holds row labels, with the text that replaces theirs."""
    e = table(spark, d, "elements").where("type = 'table'")
    bad = sections.table_misaligned(F.col("type"), F.col("content.header_row"), F.col("content.rows"))
    return e.select("element_id", F.when(bad, sections.misaligned_text(F.col("content.caption"), F.col("content.header_row"))).otherwise(F.col("content.raw")).alias("text"), bad.alias("misaligned"))


@query("""SELECT chunk_id, replace(paper_id, ' ', '_')[1:30] || '_L' || level || '_' || CASE WHEN chunk_sequence_index < 10000 THEN lpad(chunk_sequence_index::VARCHAR, 4, '0') ELSE chunk_sequence_index::VARCHAR END AS formatted,
CASE WHEN len(list_distinct(modalities)) = 1 THEN list_distinct(modalities)[1] ELSE 'mixed' END AS kind, round(order_range[1] / greatest(n, 1), 4) AS position
FROM (SELECT *, max(order_range[2]) OVER (PARTITION BY paper_id) AS n FROM chunks)""")
def chunk_identity(spark: SparkSession, d: str) -> DataFrame:
    """Formatted id, type and position of every chunk row."""
    rows = table(spark, d, "chunks").select("chunk_id", "paper_id", "level", "chunk_sequence_index", "modalities", "order_range")
    last = rows.groupBy(F.col("paper_id").alias("of")).agg(F.max(F.try_element_at("order_range", F.lit(2))).alias("n"))
    return rows.join(last, F.col("paper_id").eqNullSafe(F.col("of")), "left").select(
        "chunk_id",
        text.chunk_id(F.col("paper_id"), F.col("level"), F.col("chunk_sequence_index")).alias("formatted"),
        text.chunk_type(F.col("modalities")).alias("kind"),
        text.position_in_paper(F.try_element_at("order_range", F.lit(1)), F.col("n")).alias("position"),
    )


@query(f"""SELECT doc_id, {_tokens('text')} AS tokens, greatest(100, least(350, floor(({_tokens('text')}) * 0.30)::BIGINT)) AS limit_by_tokens,
greatest(100, least(350, floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[{_W}]+'), lambda w: w <> '')) * 0.30)::BIGINT)) AS limit_by_words FROM documents""")
def word_limits(spark: SparkSession, d: str) -> DataFrame:
    n = text.count_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("tokens"), text.word_limit(n).alias("limit_by_tokens"), text.word_limit(text.word_count(F.col("text"))).alias("limit_by_words"))


_UNITS = f"""flatten(list_transform(list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {_strip('p')}), lambda p: p <> ''), lambda p: CASE WHEN {_tokens('p')} > 300 THEN {_sentences('p')} ELSE [p] END))"""


@query(f"""WITH RECURSIVE u AS (SELECT doc_id, unnest(u) AS unit, generate_subscripts(u, 1) AS k FROM (SELECT doc_id, {_UNITS} AS u FROM documents WHERE text IS NOT NULL)),
f AS (SELECT doc_id, k, 0 AS part_no, unit AS open FROM u WHERE k = 1 UNION ALL SELECT f.doc_id, u.k, CASE WHEN {_tokens("f.open || chr(10) || chr(10) || u.unit")} <= 300 THEN f.part_no ELSE f.part_no + 1 END, CASE WHEN {_tokens("f.open || chr(10) || chr(10) || u.unit")} <= 300 THEN f.open || chr(10) || chr(10) || u.unit ELSE u.unit END FROM f JOIN u ON u.doc_id = f.doc_id AND u.k = f.k + 1)
SELECT doc_id, part_no::BIGINT AS part_no, arg_max(open, k) AS part FROM f GROUP BY 1, 2""")
def paragraph_packs(spark: SparkSession, d: str) -> DataFrame:
    """The parts of at most 300 tokens that a summary of each document would be made from."""
    parts = text.pack_paragraphs(F.col("text"), 300)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(parts).alias("part_no", "part"))


_ENDS = f"list_filter(list_transform(string_split(text, '.'), lambda s: {_strip('s')}), lambda s: s <> '')"


@query(f"""SELECT doc_id, CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 THEN s[1] || '.' ELSE s[1] || '. ' || s[-1] || '.' END AS summary FROM (SELECT doc_id, {_ENDS} AS s FROM documents WHERE text IS NOT NULL)""")
def extractive_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.extractive_summary(F.array("text")).alias("summary"))


@query(f"SELECT section_title, {_strip('section_title')}.lower()[1:50] AS label, count(DISTINCT paper_id) AS n_papers FROM chunks GROUP BY 1, 2")
def tag_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("section_title", text.tag_label(F.col("section_title")).alias("label")).agg(F.count_distinct("paper_id").alias("n_papers"))


@query("""SELECT id, cursor, split_part(decode(from_base64(cursor)), '|', 1) AS value, split_part(decode(from_base64(cursor)), '|', 2) AS row_id
FROM (SELECT id, base64(encode(epoch_us(created_at)::VARCHAR || '|' || id)) AS cursor FROM chat_sessions)""")
def page_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Cursor of every session in creation order, and what it decodes to."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = table(spark, d, "chat_sessions").select("id", F.regexp_replace(text.encode_cursor(at, F.col("id")), "\\s", "").alias("cursor"))
    back = text.decode_cursor(F.col("cursor"))
    return rows.select("id", "cursor", back["value"].alias("value"), back["id"].alias("row_id"))


_DELAYS = (r"try again in ([0-9]+\.?[0-9]*)s", r"retry after ([0-9]+) second", r"retryDelay\W+([0-9]+)s")


@query("""WITH m AS (SELECT event_id, user_id % 12 AS attempt, CASE event_type WHEN 'error' THEN 'Rate limit reached. Please try again in ' || (value * 100)::BIGINT / 100 || 's' WHEN 'click' THEN 'quota exceeded, retry after ' || floor(value)::BIGINT || ' seconds' WHEN 'view' THEN 'retryDelay: ' || floor(value)::BIGINT || 's' WHEN 'purchase' THEN 'service unavailable' ELSE '' END AS message FROM events)
SELECT event_id, coalesce(trunc(try_cast(nullif(regexp_extract(message, 'try again in ([0-9]+\\.?[0-9]*)s', 1), '') AS DOUBLE))::BIGINT, trunc(try_cast(nullif(regexp_extract(message, 'retry after ([0-9]+) second', 1), '') AS DOUBLE))::BIGINT,
trunc(try_cast(nullif(regexp_extract(message, 'retryDelay\\W+([0-9]+)s', 1), '') AS DOUBLE))::BIGINT, -1) AS wait, least(120.0, 5.0 * pow(2.0, attempt))::DOUBLE AS backoff,
CASE WHEN message ILIKE '%rate limit%' OR message ILIKE '%quota%' THEN 'limit' WHEN message ILIKE '%unavailable%' THEN 'server' ELSE 'other' END AS kind, message NOT ILIKE '' AND attempt < 5 AS retries FROM m""")
def call_limits(spark: SparkSession, d: str) -> DataFrame:
    """Wait named by a message, back-off by attempt, class of the message and whether the call is made again, for a message made of every event."""
    whole = F.floor("value").cast("string")
    seconds = (F.round(F.col("value") * 100).cast("bigint") / 100).cast("string")
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("Rate limit reached. Please try again in "), seconds, F.lit("s")))
        .when(kind == "click", F.concat(F.lit("quota exceeded, retry after "), whole, F.lit(" seconds")))
        .when(kind == "view", F.concat(F.lit("retryDelay: "), whole, F.lit("s")))
        .when(kind == "purchase", "service unavailable")
        .otherwise("")
    )
    rows = table(spark, d, "events").select("event_id", message.alias("message"), (F.col("user_id") % 12).alias("attempt"))
    m = F.lower("message")
    sort = F.when(m.contains("rate limit") | m.contains("quota"), "limit").when(m.contains("unavailable"), "server").otherwise("other")
    return rows.select("event_id", F.coalesce(text.first_number(F.col("message"), _DELAYS), F.lit(-1)).alias("wait"), text.backoff(F.col("attempt"), 5, 120).alias("backoff"), sort.alias("kind"), ((m != "") & (F.col("attempt") < 5)).alias("retries"))


def _sum(words: list[str]) -> str:
    return " + ".join(f"contains(q, '{w}')::INT" for w in words)


def _or(words: list[str]) -> str:
    return " OR ".join(f"contains(q, '{w}')" for w in words)


_SIGNALS = rf"""SELECT id, q, {_sum(signals.SPECIFIC)} + regexp_matches(q, '{signals.NUMBER}')::INT AS specific_score, {_sum(signals.BROAD)} + 3 AS broad_score,
({_or(signals.TABLE)}) AS table_signal, ({_or(signals.EQUATION)}) AS equation_signal, ({_or(signals.FIGURE)}) AS figure_signal, ({_or(signals.CROSS_SECTION)}) AS cross_section, regexp_matches(q, '{signals.NUMBER}') AS has_number
FROM (SELECT id, coalesce({_strip('lower(content)')}, '') AS q FROM chat_messages)"""


@query("SELECT * EXCLUDE (q) REPLACE (specific_score::BIGINT AS specific_score, broad_score::BIGINT AS broad_score) FROM (" + _SIGNALS + ")")
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of every chat message taken as a query."""
    return table(spark, d, "chat_messages").select("id", *[c.alias(n) for n, c in signals.signals(F.col("content")).items()])


@query(f"""SELECT mode, count(*) AS n, min(CASE mode WHEN 'A' THEN 0.4 WHEN 'B' THEN 0.65 ELSE 0.5 END)::DOUBLE AS dense_weight, min(CASE mode WHEN 'B' THEN 6 WHEN 'C' THEN 12 ELSE 8 END)::BIGINT AS top_k, min(CASE mode WHEN 'C' THEN 5 ELSE 4 END)::BIGINT AS rerank_n
FROM (SELECT CASE WHEN table_signal OR equation_signal OR figure_signal THEN 'D' WHEN cross_section OR broad_score > specific_score + 1 THEN 'B' WHEN specific_score > broad_score + 1 OR has_number THEN 'A' ELSE 'C' END AS mode FROM ({_SIGNALS})) GROUP BY mode""")
def query_route(spark: SparkSession, d: str) -> DataFrame:
    """Modes chosen for the chat messages, and their plans."""
    routed = query_signals(spark, d).withColumn("mode", signals.mode())
    p = signals.plan(F.col("mode"))
    return routed.groupBy("mode").agg(F.count("*").alias("n"), *[F.min(p[f]).alias(f) for f in ("dense_weight", "top_k", "rerank_n")])


@query("""SELECT paper_id, term::BIGINT AS term, round(max(ln(1 + greatest(v, 0))), 6) AS weight FROM (SELECT paper_id, unnest(sparse_indices) AS term, unnest(sparse_values) AS v FROM chunks WHERE len(sparse_indices) = len(sparse_values))
GROUP BY 1, 2 HAVING max(ln(1 + greatest(v, 0))) > 0""")
def splade_pool(spark: SparkSession, d: str) -> DataFrame:
    """Per paper and term the largest log-saturated weight."""
    rows = table(spark, d, "chunks").where(F.size("sparse_indices") == F.size("sparse_values")).select("paper_id", F.explode(F.arrays_zip("sparse_indices", "sparse_values")).alias("x"))
    w = F.max(F.log1p(F.greatest(F.col("x.sparse_values"), F.lit(0.0))))
    return rows.groupBy("paper_id", F.col("x.sparse_indices").alias("term")).agg(w.alias("w")).where("w > 0").select("paper_id", "term", F.round("w", 6).alias("weight"))


@query("""SELECT vec_id::BIGINT AS vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squares, round(v[1], 6) AS first, round(v[16], 6) AS last FROM (
SELECT vec_id, list_transform(t, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS t, sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))""")
def matryoshka_truncate(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.truncate(F.col("embedding").cast("array<double>"), 16)
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("squares"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(15)), 6).alias("last"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM documents),
s AS (SELECT doc_id, (('0x' || md5(w)[1:8])::BIGINT % 64) AS slot, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
f AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM s GROUP BY 1)
SELECT s.doc_id, s.slot, round(s.n / f.norm, 6) AS value FROM s JOIN f ON f.doc_id = s.doc_id""")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Non-zero entries of the default encoder's vector of each document."""
    words = table(spark, d, "documents").select("doc_id", F.explode(vectors.terms(F.col("text"))).alias("w"))
    slots = words.groupBy("doc_id", F.expr("cast(conv(substring(md5(w), 1, 8), 16, 10) as bigint) % 64").alias("slot")).agg(F.count("*").cast("double").alias("n"))
    norms = slots.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return slots.join(norms, "doc_id").select("doc_id", "slot", F.round(F.col("n") / F.col("norm"), 6).alias("value"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents)
SELECT tf.term, df.df, count(*) AS n_documents, round(max(tf.tf * ln((n.n + 1) / (df.df + 1))), 6) AS top_weight, round(sum(tf.tf * ln((n.n + 1) / (df.df + 1))), 4) AS weight FROM tf JOIN df ON df.term = tf.term, n GROUP BY 1, 2""")
def term_weights(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF weights (the default sparse encoder) summed over the documents of each term."""
    docs = table(spark, d, "documents")
    tf = docs.select("doc_id", F.explode(vectors.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    w = F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))
    return tf.join(df, "term").join(F.broadcast(n), how="cross").groupBy("term", "df").agg(F.count("*").alias("n_documents"), F.round(F.max(w), 6).alias("top_weight"), F.round(F.sum(w), 4).alias("weight"))
