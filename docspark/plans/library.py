"""Relational queries of a document library: scans, writes, feeds, pages, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.text import normalize_title
from docspark.operators import relational as rel
from docspark.operators.retrieval import newest
from docspark.plans import registry
from docspark.plans.search import _CUR
from docspark.plans.textual import _title
from docspark.sources.federated import read_sources
from docspark.sources.tables import table
from docspark.work import Work

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registry(QUERIES, SQL)


def _us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("SELECT paper_id, chunk_id, chunk_sequence_index::BIGINT AS seq, len(dense_vector)::BIGINT AS dims FROM chunks WHERE level = 0 AND dense_vector IS NOT NULL")
def leaf_scan(spark: SparkSession, d: str) -> DataFrame:
    """Leaf rows that have a vector; level is pushed into the scan."""
    return table(spark, d, "chunks").where("level = 0 and dense_vector is not null").select("paper_id", "chunk_id", F.col("chunk_sequence_index").alias("seq"), F.size("dense_vector").alias("dims"))


@query("SELECT paper_id, level::BIGINT AS level, count(*) AS n FROM chunks WHERE level >= 1 AND level IN (1, 2, 3) GROUP BY 1, 2")
def level_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(F.col("level").isin(1, 2, 3)).groupBy("paper_id", "level").agg(F.count("*").alias("n"))


@query("SELECT chunk_id, level::BIGINT AS level, section_title FROM chunks WHERE level = 3 ORDER BY chunk_id, ingested_at LIMIT 10")
def level_sample(spark: SparkSession, d: str) -> DataFrame:
    """A look at ten roots (the limit is the feature)."""
    return table(spark, d, "chunks").where("level = 3").orderBy("chunk_id", "ingested_at").select("chunk_id", "level", "section_title").limit(10)


@query("WITH " + _CUR + ", w AS (SELECT DISTINCT unnest(chunk_ids) AS chunk_id FROM structural_clusters) SELECT w.chunk_id, c.chunk_id IS NOT NULL AS found, c.section_title FROM w LEFT JOIN cur c ON c.chunk_id = w.chunk_id WHERE w.chunk_id IS NOT NULL")
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    """All ids named by clusters looked up in one join."""
    wanted = table(spark, d, "structural_clusters").select(F.explode("chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()
    have = newest(table(spark, d, "chunks"), columns=("chunk_id", "section_title")).withColumn("found", F.lit(True))
    return wanted.join(have, "chunk_id", "left").select("chunk_id", F.coalesce("found", F.lit(False)).alias("found"), "section_title")


@query("SELECT paper_id, count(DISTINCT content_hash) AS n_hashes FROM chunks GROUP BY 1")
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("paper_id").agg(F.count_distinct("content_hash").alias("n_hashes"))


@query("SELECT paper_id, chunk_id, ingested_at FROM chunks WHERE has_table AND has_equation")
def modality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows with both a table and an equation."""
    return table(spark, d, "chunks").where("has_table and has_equation").select("paper_id", "chunk_id", "ingested_at")


_SPLIT = "2025-07-01 00:00:00+00"


@query(f"""WITH t AS (SELECT *, try_cast(ingested_at AS TIMESTAMPTZ) AS at FROM chunks)
SELECT i.chunk_id, i.ingested_at FROM t i WHERE i.at >= TIMESTAMPTZ '{_SPLIT}' AND NOT EXISTS (SELECT 1 FROM t s WHERE s.at < TIMESTAMPTZ '{_SPLIT}' AND s.paper_id = i.paper_id AND s.content_hash = i.content_hash)""")
def upsert_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the second half (by the time meant) that are new by paper and content hash."""
    rows = table(spark, d, "chunks").select("chunk_id", "ingested_at", "paper_id", "content_hash", F.try_to_timestamp("ingested_at").alias("at"))
    split = F.lit("2025-07-01 00:00:00").cast("timestamp")
    return rel.insert_new(rows.where(F.col("at") >= split), rows.where(F.col("at") < split), ["paper_id", "content_hash"]).select("chunk_id", "ingested_at")


@query("SELECT paper_id, content_hash, count(*) AS n_rows, min(chunk_id) AS first_id FROM chunks WHERE content_hash IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT chunk_id) > 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Hashes stored under several chunk ids of one paper."""
    g = table(spark, d, "chunks").where("content_hash is not null").groupBy("paper_id", "content_hash")
    return g.agg(F.count("*").alias("n_rows"), F.min("chunk_id").alias("first_id"), F.count_distinct("chunk_id").alias("n")).where("n > 1").drop("n")


@query("WITH " + _CUR + """, up AS (SELECT child, min(chunk_id) AS parent FROM (SELECT chunk_id, unnest(children_ids) AS child FROM cur WHERE level >= 1) GROUP BY 1)
SELECT c.chunk_id, coalesce(CASE WHEN len(c.parent_ids) > 0 THEN array_to_string(c.parent_ids, ',') END, u.parent) AS parents FROM cur c LEFT JOIN up u ON u.child = c.chunk_id""")
def link_update(spark: SparkSession, d: str) -> DataFrame:
    """Partial update by id: parents kept where present, else filled from the summaries' children."""
    c = newest(table(spark, d, "chunks"), columns=("chunk_id", "level", "parent_ids", "children_ids"))
    up = c.where("level >= 1").select(F.col("chunk_id").alias("parent"), F.explode("children_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.min("parent").alias("parent"))
    own = F.when(F.size("parent_ids") > 0, F.array_join("parent_ids", ","))
    return c.join(up, "chunk_id", "left").select("chunk_id", F.coalesce(own, F.col("parent")).alias("parents"))


@query("SELECT paper_id, count(*) FILTER (WHERE level = 0) AS n_left, count(*) FILTER (WHERE level >= 1) AS n_removed FROM chunks GROUP BY 1")
def remove_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What removing the summaries of every paper leaves and takes."""
    return table(spark, d, "chunks").groupBy("paper_id").agg(F.count_if(F.col("level") == 0).alias("n_left"), F.count_if(F.col("level") >= 1).alias("n_removed"))


_LIB = """lib AS (SELECT k.user_id, k.paper_id, p.title, p.year, p.rag_status, coalesce(epoch_us(s.last), -1) AS last_chatted, coalesce(s.n, 0) AS chat_count, k.uploaded FROM
 (SELECT user_id, paper_id, bool_or(up) AS uploaded FROM (SELECT uploaded_by AS user_id, paper_id, true AS up FROM papers WHERE uploaded_by IS NOT NULL UNION ALL SELECT user_id, paper_id, false FROM chat_sessions WHERE user_id IS NOT NULL AND paper_id IS NOT NULL) GROUP BY 1, 2) k
 JOIN papers p ON p.paper_id = k.paper_id LEFT JOIN (SELECT user_id, paper_id, max(last_message_at) AS last, count(*) AS n FROM chat_sessions GROUP BY 1, 2) s ON s.user_id = k.user_id AND s.paper_id = k.paper_id)"""


def _library(spark: SparkSession, d: str) -> DataFrame:
    papers, sessions = table(spark, d, "papers"), table(spark, d, "chat_sessions")
    held = (
        papers.where("uploaded_by is not null").select(F.col("uploaded_by").alias("user_id"), "paper_id", F.lit(True).alias("up"))
        .union(sessions.where("user_id is not null and paper_id is not null").select("user_id", "paper_id", F.lit(False)))
        .groupBy("user_id", "paper_id").agg(F.bool_or("up").alias("uploaded"))
    )
    chats = sessions.groupBy("user_id", "paper_id").agg(F.max("last_message_at").alias("last"), F.count("*").alias("n"))
    return held.join(papers.select("paper_id", "title", "year", "rag_status"), "paper_id").join(chats, ["user_id", "paper_id"], "left").select(
        "user_id", "paper_id", "title", "year", "rag_status", F.coalesce(_us("last"), F.lit(-1)).alias("last_chatted"), F.coalesce("n", F.lit(0)).alias("chat_count"), "uploaded"
    )


_PAGE = 5
_FEED = "ORDER BY last_chatted DESC NULLS LAST, paper_id DESC"


@query(f"WITH {_LIB} SELECT user_id, paper_id, last_chatted, chat_count, row_number() OVER (PARTITION BY user_id {_FEED}) AS place FROM lib QUALIFY place <= {_PAGE}")
def dashboard_feed(spark: SparkSession, d: str) -> DataFrame:
    """First page of every user's library, last chatted first."""
    rows = _library(spark, d).select("user_id", "paper_id", "last_chatted", "chat_count")
    return rel.top_per_group(rows, ["user_id"], [F.col("last_chatted").desc_nulls_last(), F.col("paper_id").desc()], _PAGE)


@query(f"WITH {_LIB} SELECT user_id, paper_id, last_chatted, chat_count, place - {_PAGE} AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id {_FEED}) AS place FROM lib) WHERE place > {_PAGE} AND place <= {2 * _PAGE}")
def dashboard_page2(spark: SparkSession, d: str) -> DataFrame:
    """Second page of every user's library, by keyset cursor."""
    rows = _library(spark, d).select("user_id", "paper_id", "last_chatted", "chat_count")
    first = rel.top_per_group(rows, ["user_id"], [F.col("last_chatted").desc_nulls_last(), F.col("paper_id").desc()], _PAGE)
    cursors = first.where(F.col("place") == _PAGE).select("user_id", F.col("last_chatted").alias("last_value"), F.col("paper_id").alias("last_id"))
    return rel.next_page(rows, cursors, "user_id", "last_chatted", "paper_id", _PAGE)


@query(f"""WITH {_LIB} SELECT user_id, paper_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE rag_status WHEN 'ready' THEN 0 WHEN 'processing' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, paper_id) AS by_status,
row_number() OVER (PARTITION BY user_id ORDER BY lower(title) NULLS LAST, paper_id) AS by_title, row_number() OVER (PARTITION BY user_id ORDER BY year DESC NULLS LAST, paper_id) AS by_year, row_number() OVER (PARTITION BY user_id ORDER BY chat_count DESC, paper_id) AS by_chats FROM lib""")
def dashboard_orders(spark: SparkSession, d: str) -> DataFrame:
    """The place of every library row under each sort key."""
    rank = F.when(F.col("rag_status") == "ready", 0).when(F.col("rag_status") == "processing", 1).when(F.col("rag_status") == "failed", 2).otherwise(3)
    place = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "paper_id"))
    return _library(spark, d).select(
        "user_id", "paper_id", place(rank).alias("by_status"), place(F.lower("title").asc_nulls_last()).alias("by_title"), place(F.col("year").desc_nulls_last()).alias("by_year"), place(F.col("chat_count").desc()).alias("by_chats")
    )


@query(f"WITH {_LIB} SELECT user_id, count(*) AS n_papers, count(*) FILTER (WHERE uploaded) AS n_uploaded FROM lib WHERE paper_id IN (SELECT paper_id FROM chunks WHERE {_title('section_title')} = 'results') GROUP BY 1")
def dashboard_tag(spark: SparkSession, d: str) -> DataFrame:
    """Library rows whose paper carries a tag (a section called results)."""
    tagged = table(spark, d, "chunks").where(normalize_title(F.col("section_title")) == "results").select("paper_id")
    return _library(spark, d).join(tagged, "paper_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n_papers"), F.count_if("uploaded").alias("n_uploaded"))


@query("""SELECT a.name AS collection, count(DISTINCT paper_id) AS n_papers, max(epoch_us(updated_at)) AS updated FROM (SELECT paper_id, updated_at, unnest(authors) AS a FROM papers) WHERE a.name IS NOT NULL GROUP BY 1""")
def collections(spark: SparkSession, d: str) -> DataFrame:
    """Papers per author taken as a collection, with its latest change."""
    rows = table(spark, d, "papers").select("paper_id", "updated_at", F.explode("authors").alias("a")).where("a.name is not null")
    return rows.groupBy(F.col("a.name").alias("collection")).agg(F.count_distinct("paper_id").alias("n_papers"), F.max(_us("updated_at")).alias("updated"))


_SOURCES = ("upload", "journal_feed", "preprint_feed")


@query("""WITH l AS (SELECT *, CASE lower(source) WHEN 'upload' THEN 0 WHEN 'journal_feed' THEN 1 WHEN 'preprint_feed' THEN 2 END AS list_no FROM papers),
one AS (SELECT * FROM l WHERE list_no IS NOT NULL AND (doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY list_no, paper_id) = 1)) SELECT o.paper_id, o.doi, o.list_no::BIGINT AS list_no, coalesce(s.n, 0) AS n_sessions, coalesce(o.rag_status, 'none') AS status
FROM (SELECT l.* FROM l WHERE list_no IS NOT NULL QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY list_no, paper_id) = 1) o LEFT JOIN (SELECT paper_id, count(*) AS n FROM chat_sessions GROUP BY 1) s ON s.paper_id = o.paper_id
WHERE o.year BETWEEN 2000 AND 2025 AND list_bool_or(list_transform(o.authors, lambda a: contains(lower(a.name), 'a')))""")
def discovery_federated(spark: SparkSession, d: str) -> DataFrame:
    """Result lists of several sources, one row per DOI, with library annotation and filters by year and author."""
    papers = table(spark, d, "papers").select("paper_id", "doi", "source", "year", "authors", "rag_status")
    one = rel.first_of_union([papers.where(F.lower("source") == s) for s in _SOURCES], "doi", ["paper_id"])
    chats = table(spark, d, "chat_sessions").groupBy("paper_id").agg(F.count("*").alias("n"))
    named = F.exists("authors", lambda a: F.contains(F.lower(a["name"]), F.lit("a")))
    some = one.where(F.col("year").between(2000, 2025) & F.coalesce(named, F.lit(False)))
    return some.join(chats, "paper_id", "left").select("paper_id", "doi", "list_no", F.coalesce("n", F.lit(0)).alias("n_sessions"), F.coalesce("rag_status", F.lit("none")).alias("status"))


_LIVE = """v AS (SELECT * FROM chat_messages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
live AS (SELECT v.* FROM v LEFT JOIN chat_sessions s ON s.id = v.session_id WHERE v.deleted_at IS NULL AND (s.cleared_at IS NULL OR v.created_at > s.cleared_at))"""


def live_messages(spark: SparkSession, d: str) -> DataFrame:
    """Newest versions of messages that are neither deleted nor cleared."""
    m = table(spark, d, "chat_messages").where("id is not null")
    keep = [c for c in m.columns if c != "id"]
    one = m.groupBy("id").agg(F.max_by(F.struct(*keep), F.struct("updated_at")).alias("m")).select("id", *[F.col(f"m.{c}").alias(c) for c in keep])
    s = table(spark, d, "chat_sessions").select(F.col("id").alias("session_id"), "cleared_at")
    return one.where("deleted_at is null").join(s, "session_id", "left").where("cleared_at is null or created_at > cleared_at")


@query(f"WITH {_LIVE} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS place, epoch_us(created_at) AS created FROM live")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return live_messages(spark, d).select("session_id", "id", F.row_number().over(w).alias("place"), _us("created_at").alias("created"))


@query(f"WITH {_LIVE} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS place FROM (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) <= 6)")
def recent_messages(spark: SparkSession, d: str) -> DataFrame:
    """The last six messages of every session, oldest first."""
    last = rel.top_per_group(live_messages(spark, d), ["session_id"], [F.desc("created_at"), F.desc("id")], 6)
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return last.select("session_id", "id", F.row_number().over(w).alias("place"))


@query(f"""WITH {_LIVE}, o AS (SELECT session_id, id, row_number() OVER w AS turn, string_agg(id, ',') OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS turns FROM live WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id))
SELECT session_id, id, turn, turns FROM o WHERE turn % 4 = 0""")
def rolling_points(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth turn of a session with the turns it closes."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    o = live_messages(spark, d).select("session_id", "id", F.row_number().over(w).alias("turn"), F.array_join(F.collect_list("id").over(w.rowsBetween(-3, 0)), ",").alias("turns"))
    return o.where("turn % 4 = 0")


@query("""SELECT (SELECT count(DISTINCT user_id) FROM chat_sessions) AS n_users, (SELECT count(*) FROM papers) AS n_papers, (SELECT count(*) FROM papers WHERE rag_status = 'ready') AS n_ready, (SELECT count(*) FROM chat_sessions) AS n_sessions""")
def platform_stats(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "chat_sessions").agg(F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n_sessions"))
    papers = table(spark, d, "papers").agg(F.count("*").alias("n_papers"), F.count_if(F.col("rag_status") == "ready").alias("n_ready"))
    return users.join(papers, how="cross").select("n_users", "n_papers", "n_ready", "n_sessions")  # two single rows


@query("SELECT count(DISTINCT user_id) AS n_active FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def active_users_7d(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") > F.col("last") - F.expr("interval 7 days")).agg(F.count_distinct("user_id").alias("n_active"))


@query("SELECT floor(avg(value))::BIGINT AS mean_value, count(*) AS n FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def avg_last_1000(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).agg(F.floor(F.avg("value")).cast("bigint").alias("mean_value"), F.count("*").alias("n"))


@query("""SELECT u.user_id, coalesce(p.n, 0) AS paper_count, coalesce(s.n, 0) AS total_chats, coalesce(s.last, -1) AS last_chat FROM (SELECT uploaded_by AS user_id FROM papers WHERE uploaded_by IS NOT NULL UNION SELECT user_id FROM chat_sessions WHERE user_id IS NOT NULL) u
LEFT JOIN (SELECT uploaded_by, count(*) AS n FROM papers GROUP BY 1) p ON p.uploaded_by = u.user_id LEFT JOIN (SELECT user_id, count(*) AS n, max(epoch_us(last_message_at)) AS last FROM chat_sessions GROUP BY 1) s ON s.user_id = u.user_id""")
def admin_users(spark: SparkSession, d: str) -> DataFrame:
    """Papers and chats per user: one aggregation over the union of both, no join."""
    p = table(spark, d, "papers").select(F.col("uploaded_by").alias("user_id"), F.lit(1).alias("p"), F.lit(0).alias("s"), F.lit(None).cast("bigint").alias("last"))
    s = table(spark, d, "chat_sessions").select("user_id", F.lit(0), F.lit(1), _us("last_message_at"))
    return p.union(s).where("user_id is not null").groupBy("user_id").agg(F.sum("p").alias("paper_count"), F.sum("s").alias("total_chats"), F.coalesce(F.max("last"), F.lit(-1)).alias("last_chat"))


@query("SELECT paper_id, title, lower(source) AS source, rag_status, row_number() OVER (ORDER BY created_at DESC, paper_id DESC) AS place FROM papers WHERE rag_status = 'ready' AND contains(lower(title), 'a') QUALIFY place <= 20")
def admin_papers(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty ready papers with a phrase in the title (a top-k report)."""
    some = table(spark, d, "papers").where((F.col("rag_status") == "ready") & F.contains(F.lower("title"), F.lit("a"))).orderBy(F.desc("created_at"), F.desc("paper_id")).limit(20)
    w = Window.orderBy(F.desc("created_at"), F.desc("paper_id"))  # over twenty rows
    return some.select("paper_id", "title", F.lower("source").alias("source"), "rag_status", F.row_number().over(w).alias("place"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, count(*) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY user_id) AS unread FROM events WHERE event_type <> 'signup' QUALIFY place <= 3")
def notification_feed(spark: SparkSession, d: str) -> DataFrame:
    """Each user's newest three notices, with the number unread across all pages."""
    e = table(spark, d, "events").where("event_type <> 'signup'")
    unread = e.groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("unread"))
    top = rel.top_per_group(e.select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return top.join(unread, "user_id").select("user_id", "event_id", "event_type", "place", "unread")


@query("SELECT user_id, arg_max(event_type, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END) AS event_type FROM events GROUP BY 1")
def status_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return rel.strongest(table(spark, d, "events"), ["user_id"], "event_type", {"view": 0, "click": 1, "signup": 2, "purchase": 3})


@query("SELECT user_id, paper_id, count(*) AS n FROM (SELECT DISTINCT user_id, paper_id FROM chat_sessions UNION SELECT uploaded_by, paper_id FROM papers) WHERE user_id IS NOT NULL GROUP BY 1, 2")
def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    """Uploads inserted into the chatted pairs; pairs that are there stay single."""
    have = table(spark, d, "chat_sessions").select("user_id", "paper_id").distinct()
    new = rel.insert_new(table(spark, d, "papers").select(F.col("uploaded_by").alias("user_id"), "paper_id"), have, ["user_id", "paper_id"], within=True)
    return have.unionByName(new).where("user_id is not null").groupBy("user_id", "paper_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50)")
def family_revocation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of families (users) in which no row is marked as replayed."""
    e = table(spark, d, "events")
    bad = e.where("event_type = 'error' and value > 50").select("user_id")
    return e.join(bad, "user_id", "left_anti").select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n_valid FROM events WHERE ts > TIMESTAMP '2024-01-20' AND value <= 90 GROUP BY 1")
def expired_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have not expired by a given time and are not used up."""
    return table(spark, d, "events").where((F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("value") <= 90)).groupBy("event_type").agg(F.count("*").alias("n_valid"))


@query(f"WITH {_LIB} SELECT paper_id, user_id, count(*) OVER (PARTITION BY paper_id) AS n_users FROM lib")
def subscribers(spark: SparkSession, d: str) -> DataFrame:
    """Everyone who holds a paper, one row each, with how many they are."""
    rows = _library(spark, d).select("paper_id", "user_id")
    return rows.join(rows.groupBy("paper_id").agg(F.count("*").alias("n_users")), "paper_id").select("paper_id", "user_id", "n_users")


@query("""WITH gone AS (SELECT paper_id FROM papers WHERE rag_status = 'failed') SELECT 'chunks' AS child, count(*) AS n_left FROM chunks WHERE paper_id NOT IN (SELECT paper_id FROM gone) UNION ALL SELECT 'elements', count(*) FROM elements WHERE paper_id NOT IN (SELECT paper_id FROM gone)
UNION ALL SELECT 'chat_sessions', count(*) FROM chat_sessions WHERE paper_id NOT IN (SELECT paper_id FROM gone) UNION ALL SELECT 'chat_messages', count(*) FROM chat_messages WHERE paper_id NOT IN (SELECT paper_id FROM gone)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left in the child tables once failed papers are removed."""
    gone = table(spark, d, "papers").where("rag_status = 'failed'").select(F.col("paper_id").alias("id"))
    left = rel.cascade({t: (table(spark, d, t).select("paper_id"), "paper_id") for t in ("chunks", "elements", "chat_sessions", "chat_messages")}, gone)
    out = None
    for name, rows in left.items():
        part = rows.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("child"), "n_left")
        out = part if out is None else out.union(part)
    return out


@query("WITH " + _CUR + """, pre AS (SELECT paper_id, string_agg(chunk_id, ',' ORDER BY chunk_sequence_index, chunk_id) AS preview FROM (SELECT * FROM cur WHERE level = 0 QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY chunk_sequence_index, chunk_id) <= 3) GROUP BY 1)
SELECT p.paper_id, CASE WHEN p.rag_status = 'ready' THEN pre.preview END AS preview, coalesce(m.n, 0) AS n_messages, coalesce(list_count(p.authors), 0) AS n_authors FROM papers p LEFT JOIN pre ON pre.paper_id = p.paper_id LEFT JOIN (SELECT paper_id, count(DISTINCT id) AS n FROM chat_messages GROUP BY 1) m ON m.paper_id = p.paper_id""")
def paper_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with its first three chunks (when ready), messages and authors."""
    leaves = newest(table(spark, d, "chunks"), columns=("chunk_id", "paper_id", "level", "chunk_sequence_index")).where("level = 0")
    top = rel.top_per_group(leaves, ["paper_id"], [F.col("chunk_sequence_index"), F.col("chunk_id")], 3)
    pre = top.groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("preview"))
    n = table(spark, d, "chat_messages").groupBy("paper_id").agg(F.count_distinct("id").alias("n"))
    return table(spark, d, "papers").join(pre, "paper_id", "left").join(n, "paper_id", "left").select(
        "paper_id", F.when(F.col("rag_status") == "ready", F.col("preview")).alias("preview"), F.coalesce("n", F.lit(0)).alias("n_messages"), F.coalesce(F.when(F.col("authors").isNotNull(), F.size(F.filter("authors", lambda a: a.isNotNull()))), F.lit(0)).alias("n_authors")
    )


@query("SELECT a.paper_id, min(b.paper_id) AS same_as FROM papers a JOIN papers b ON (b.content_hash = a.content_hash OR b.doi = a.doi) AND b.paper_id < a.paper_id GROUP BY 1")
def upload_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Papers that equal an earlier one by content hash or DOI: two equi-joins instead of one with OR."""
    p = table(spark, d, "papers").select("paper_id", "content_hash", "doi")
    out = None
    for key in ("content_hash", "doi"):
        first = p.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("paper_id").alias("same_as"))
        part = p.join(first, key).where("same_as < paper_id").select("paper_id", "same_as")
        out = part if out is None else out.union(part)
    return out.groupBy("paper_id").agg(F.min("same_as").alias("same_as"))


@query("SELECT user_id, count(*) AS n_steps, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, CASE WHEN bool_and(event_type <> 'error') THEN sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT ELSE -1 END AS total_if_done FROM events GROUP BY 1")
def trace_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the steps' numbers read from JSON; -1 unless all steps are done."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_steps"), F.sum(k).alias("total"), F.when(F.bool_and(F.col("event_type") != "error"), F.sum(k)).otherwise(-1).alias("total_if_done"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_no, event_type AS step, CAST(json_extract_string(props, '$.k') AS BIGINT) AS duration, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS waited_us FROM events")
def trace_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of every trace in order, with the number read from JSON and the time since the step before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    waited = F.coalesce(_us("ts") - F.lag(_us("ts")).over(w), F.lit(0))
    return table(spark, d, "events").select("user_id", F.row_number().over(w).alias("step_no"), F.col("event_type").alias("step"), F.from_json("props", "k bigint")["k"].alias("duration"), waited.alias("waited_us"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH {_LIB}, q AS (SELECT id, user_id, {_WORDS.format(t="coalesce(rolling_summary, '')")} AS q FROM chat_sessions),
t AS (SELECT paper_id, {_WORDS.format(t="coalesce(title, '') || ' ' || coalesce(array_to_string(list_transform(authors, lambda a: a.name), ' '), '')")} AS t FROM papers)
SELECT q.id, lib.paper_id FROM q JOIN lib ON lib.user_id = q.user_id JOIN t ON t.paper_id = lib.paper_id WHERE len(q.q) > 0 AND list_has_all(t.t, q.q)""")
def fulltext_library(spark: SparkSession, d: str) -> DataFrame:
    """Every paper of the session user's library whose title and authors hold all words of the session's summary."""
    named = F.coalesce(F.array_join(F.transform("authors", lambda a: a["name"]), " "), F.lit(""))
    texts = table(spark, d, "papers").select("paper_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), named).alias("text"))
    library = _library(spark, d).select("user_id", "paper_id").join(texts, "paper_id")
    return rel.contains_all(table(spark, d, "chat_sessions").select("id", "user_id", F.col("rolling_summary").alias("text")), library)


_ABSTRACT = f"""ab AS (SELECT paper_id, string_agg(text_for_embedding, ' ' ORDER BY chunk_id) AS abstract FROM cur WHERE level = 0 AND {_title('section_title')} = 'abstract' GROUP BY 1),
txt AS (SELECT p.paper_id, p.title, coalesce(title, '') || ' ' || coalesce(array_to_string(list_transform(authors, lambda a: a.name), ' '), '') || ' ' || coalesce(ab.abstract, '') AS t FROM papers p LEFT JOIN ab ON ab.paper_id = p.paper_id)"""


def _searchable(spark: SparkSession, d: str) -> DataFrame:
    """``(paper_id, text)``: title and authors of every paper, and each chunk of its abstract."""
    leaves = newest(table(spark, d, "chunks"), columns=("chunk_id", "paper_id", "level", "section_title", "text_for_embedding")).where("level = 0")
    abstract = leaves.where(normalize_title(F.col("section_title")) == "abstract").select("paper_id", F.col("text_for_embedding").alias("text"))
    named = F.array_join(F.transform("authors", lambda a: a["name"]), " ")
    return table(spark, d, "papers").select("paper_id", F.concat_ws(" ", "title", named).alias("text")).union(abstract)


@query(f"""WITH {_CUR}, {_ABSTRACT}, {_LIB}, t AS (SELECT paper_id, {_WORDS.format(t="t")} AS w FROM txt), q AS (SELECT user_id, paper_id AS asked, list_slice({_WORDS.format(t="coalesce(title, '')")}, 1, 3) AS q FROM lib)
SELECT q.user_id, q.asked, lib.paper_id FROM q JOIN lib ON lib.user_id = q.user_id JOIN t ON t.paper_id = lib.paper_id WHERE len(q.q) > 0 AND list_has_all(t.w, q.q)""".replace("list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: w <> ''))", "list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: w <> '')"))
def fulltext_search(spark: SparkSession, d: str) -> DataFrame:
    """For every paper a user holds, the papers of the user's library whose title, authors and abstract hold its title's first three words."""
    library = _library(spark, d).select("user_id", "paper_id", "title")
    every = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    asked = library.select(F.struct("user_id", "paper_id").alias("id"), "user_id", F.array_join(F.slice(every, 1, 3), " ").alias("text"))
    return rel.contains_all_within(asked, library, _searchable(spark, d)).select("id.user_id", F.col("id.paper_id").alias("asked"), "paper_id")


@query("""WITH l AS (SELECT paper_id, doi, year, CASE lower(source) WHEN 'upload' THEN 0 WHEN 'journal_feed' THEN 1 WHEN 'preprint_feed' THEN 2 END AS list_no FROM papers)
SELECT paper_id, doi, CASE WHEN list_no = 2 THEN NULL ELSE year END::BIGINT AS year, CASE list_no WHEN 0 THEN 'upload' WHEN 1 THEN 'journal_feed' ELSE 'preprint_feed' END AS source, list_no::BIGINT AS list_no FROM l WHERE list_no IS NOT NULL QUALIFY doi IS NULL OR row_number() OVER (PARTITION BY doi ORDER BY list_no, paper_id) = 1""")
def federated_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three sources in three formats (the last without years) read as one list, one row per DOI."""
    work = Work(spark, "federated")
    papers = table(spark, d, "papers").select("paper_id", "doi", "year", F.lower("source").alias("of"))
    places = {}
    for name, kind, columns in zip(_SOURCES, ("parquet", "json", "csv"), (("paper_id", "doi", "year"), ("paper_id", "doi", "year"), ("doi", "paper_id"))):
        places[name] = (kind, work.path(name))
        writer = papers.where(F.col("of") == name).select(*columns).write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(places[name][1])
    every = read_sources(spark, places, "paper_id string, doi string, year int")
    best = every.where("doi is not null").groupBy("doi").agg(F.min_by(F.struct("paper_id", "year", "source", "list_no"), F.struct("list_no", "paper_id")).alias("x")).select("x.paper_id", "doi", "x.year", "x.source", "x.list_no")
    return best.unionByName(every.where("doi is null").select(*best.columns))
