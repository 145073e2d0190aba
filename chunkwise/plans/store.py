"""Queries over the life of the store: what is new, unchanged, stale, repeated or gone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chunkwise.functions import text as tx
from chunkwise.operators import store
from chunkwise.plans import search
from chunkwise.session import shared_dir, table

NOW = 1_757_100_000_000
WEEK = 7 * store.DAY_MS


def _chunks(spark, d):
    return table(spark, d, "chunks")


def _scan(spark, d):
    """Newest sighting of each source."""
    s = table(spark, d, "source_scan").where("source IS NOT NULL")
    best = s.groupBy("source").agg(F.max_by(F.struct("mtime", "content_hash", "status_code", "kind", "scan_id"), F.struct("scanned_at", "scan_id")).alias("x"))
    return best.select("source", "x.*")


def list_documents(spark, d):
    return store.source_stats(_chunks(spark, d))


def staleness_status(spark, d):
    probe = _scan(spark, d).select("source", F.col("mtime").alias("current_mtime"))
    return store.staleness(store.source_stats(_chunks(spark, d)), probe, NOW, WEEK).select("source", "status")


def store_status(spark, d):
    probe = _scan(spark, d).select("source", F.col("mtime").alias("current_mtime"))
    return store.totals(store.staleness(store.source_stats(_chunks(spark, d)), probe, NOW, WEEK))


def stored_bytes(spark, d):
    c = _chunks(spark, d).where("content IS NOT NULL")
    return c.agg(F.sum(F.octet_length("content")).alias("bytes")).select("bytes", tx.human_size("bytes").alias("shown"))


def incremental_anti_join(spark, d):
    """Sources whose (source, mtime) is not stored: no content is read for the others."""
    state = store.source_stats(_chunks(spark, d)).select("source", "mtime")
    return _scan(spark, d).select("source", "mtime").join(state, ["source", "mtime"], "left_anti")


def unchanged_predicate(spark, d):
    return store.unchanged(_scan(spark, d), store.source_stats(_chunks(spark, d))).select("source", "unchanged")


def ingest_actions(spark, d):
    return store.ingest_plan(_scan(spark, d), store.source_stats(_chunks(spark, d))).select("source", "action")


def ingest_counters(spark, d):
    p = store.ingest_plan(_scan(spark, d), store.source_stats(_chunks(spark, d)))
    return p.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("add", "update", "skip", "failed")])


def reingest_plan(spark, d):
    return store.reingest_plan(store.source_stats(_chunks(spark, d)), _scan(spark, d), NOW, WEEK)


def reingest_counters(spark, d):
    p = reingest_plan(spark, d)
    return p.agg(F.count_if(F.col("status") == "STALE").alias("stale"), *[F.count_if(F.col("action") == a).alias(a) for a in ("replace", "touch", "skip", "keep")])


def http_status_filter(spark, d):
    return table(spark, d, "source_scan").where("status_code IS NULL OR status_code < 400").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash("text").alias("digest"))


def dedupe_by_hash(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy(tx.content_hash("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def repeated_chunk_ids(spark, d):
    return _chunks(spark, d).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_versions(spark, d):
    return store.latest_versions(_chunks(spark, d))


def chunk_index_gaps(spark, d):
    return store.missing_indexes(_chunks(spark, d))


def empty_output_sources(spark, d):
    """Scanned sources for which the store holds no chunk with text."""
    c = _chunks(spark, d).where("length(trim(content)) > 0").select("source").distinct()
    return _scan(spark, d).select("source").join(c, "source", "left_anti")


def vanished_sources(spark, d):
    s = table(spark, d, "source_scan").select("source").distinct()
    return store.source_stats(_chunks(spark, d)).select("source", "chunks").join(s, "source", "left_anti")


def delete_sources(spark, d):
    """Chunks left per kind of source when everything under one folder is deleted."""
    c = _chunks(spark, d)
    gone = c.where(F.col("source").startswith("/srv/mirror/")).select("source").distinct()
    left = c.join(gone, "source", "left_anti")
    return left.groupBy(tx.extension("source").alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def delete_counts(spark, d):
    return _chunks(spark, d).where(F.col("source").startswith("/srv/mirror/")).groupBy("source").agg(F.count(F.lit(1)).alias("removed"))


def point_lookup(spark, d):
    c = _chunks(spark, d).where(F.col("source") == "/srv/corpus/handbook/operations-journal.md").dropDuplicates(["chunk_id"])
    return c.select("chunk_index", "chunk_id", F.length("content").cast("bigint").alias("n_chars"), "heading_title")


def run_summary(spark, d):
    """What each run wrote, with its outcome."""
    log, runs = table(spark, d, "ingest_log"), table(spark, d, "ingest_runs")
    n = log.distinct().groupBy("run_id").agg(F.count_distinct("source").alias("sources"), F.count_if(F.col("content_hash").isNull()).alias("no_hash"))
    return runs.join(n, "run_id", "left").select("run_id", "run_status", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("no_hash", F.lit(0)).alias("no_hash"), tx.iso_utc("started_ms").alias("started"))


def late_arrivals(spark, d):
    s = table(spark, d, "source_scan")
    return s.where(F.col("arrived_at") > F.col("scanned_at") + F.expr("INTERVAL 1 DAY")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


def _store(spark, rows):
    """A new store in the shared folder with ``rows``, in two segments."""
    made = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    half = F.pmod(F.xxhash64("source"), F.lit(2))
    made.upsert(rows.where(half == 0))
    made.upsert(rows.where(half == 1))
    return made


def _lived(spark, d):
    """A store of all chunks after one folder was replaced, another deleted, and the pages touched."""
    rows = _chunks(spark, d).where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"]).drop("lang", "vector")
    made = _store(spark, rows)
    again = rows.where(F.col("source").startswith("/srv/repo/")).select("source").distinct()
    made.upsert(again.select(F.concat("source", F.lit("#new")).alias("chunk_id"), "source", F.lit(1).cast("bigint").alias("mtime"), F.lit(0).alias("chunk_index"), F.lit("replaced").alias("content"), F.lit("h").alias("content_hash")))
    made.delete_all(rows.where(F.col("source").startswith("/srv/mirror/")))
    made.touch(rows.where(F.col("source").startswith("http")), NOW)
    return made


def store_chunks(spark, d):
    """Chunks of a store after upsert, delete and touch."""
    return _lived(spark, d).chunks().select("chunk_id", "source", "mtime", "ingest_time", F.length("content").cast("bigint").alias("n_chars"))


def store_state(spark, d):
    """Figures per source of the same store, from what was written with the segments."""
    return _lived(spark, d).state()


def store_bm25(spark, d):
    """Search from stored postings in two segments."""
    made = _store(spark, _chunks(spark, d).where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"]).drop("lang", "vector"))
    return made.search(table(spark, d, "queries"), 5, "bm25").select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


NAMES = (store_chunks, store_state, store_bm25, list_documents, staleness_status, store_status, stored_bytes, incremental_anti_join, unchanged_predicate, ingest_actions, ingest_counters, reingest_plan, reingest_counters, http_status_filter, content_hash, dedupe_by_hash, repeated_chunk_ids, latest_versions, chunk_index_gaps, empty_output_sources, vanished_sources, delete_sources, delete_counts, point_lookup, run_summary, late_arrivals)
QUERIES = {f.__name__: f for f in NAMES}

SCAN = "scan AS (SELECT * FROM source_scan WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY scanned_at DESC, scan_id DESC) = 1)"
STATE = "st AS (SELECT source, count(*) AS chunks, max(mtime) AS mtime, max(ingest_time) AS ingest_time, min(content_hash) AS content_hash FROM chunks WHERE source IS NOT NULL GROUP BY 1)"
FRESH = f"CASE WHEN coalesce(CASE WHEN regexp_matches(st.source, '^https?://') THEN coalesce(st.ingest_time, 0) > 0 AND {NOW} - st.ingest_time < {WEEK} ELSE scan.mtime = st.mtime END, false) THEN 'CURRENT' ELSE 'STALE' END"
# three-valued OR: a null on one side must not hide a true on the other
SAME = "(coalesce(scan.mtime <> 0 AND scan.mtime = st.mtime, false) OR coalesce(scan.content_hash = st.content_hash, false))"
ACT = f"act AS (SELECT scan.source, CASE WHEN coalesce(scan.status_code, 0) >= 400 THEN 'failed' WHEN {SAME} THEN 'skip' WHEN st.source IS NULL THEN 'add' ELSE 'update' END AS action FROM scan LEFT JOIN st ON st.source = scan.source)"
RE = f"re AS (SELECT *, CASE WHEN status = 'CURRENT' THEN 'keep' WHEN seen IS NULL OR coalesce(code, 0) >= 400 THEN 'skip' WHEN regexp_matches(source, '^https?://') AND coalesce(h = content_hash, false) THEN 'touch' ELSE 'replace' END AS action FROM (SELECT st.source, st.content_hash, scan.source AS seen, scan.status_code AS code, scan.content_hash AS h, {FRESH} AS status FROM st LEFT JOIN scan ON scan.source = st.source))"
LIVED = f"""
WITH one AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1), live AS (
    SELECT chunk_id, source, mtime, CASE WHEN starts_with(source, 'http') THEN {NOW} ELSE ingest_time END AS ingest_time, content, content_hash
    FROM one WHERE source IS NULL OR NOT (starts_with(source, '/srv/repo/') OR starts_with(source, '/srv/mirror/'))
    UNION ALL SELECT DISTINCT source || '#new', source, 1, NULL::BIGINT, 'replaced', 'h' FROM one WHERE starts_with(source, '/srv/repo/')
)
"""
SQL = {
    "store_chunks": LIVED + "SELECT chunk_id, source, mtime, ingest_time, length(content) AS n_chars FROM live",
    "store_state": LIVED + "SELECT source, count(*) AS chunks, max(mtime) AS mtime, max(ingest_time) AS ingest_time, min(content_hash) AS content_hash FROM live WHERE source IS NOT NULL GROUP BY 1",
    "list_documents": f"WITH {STATE} SELECT * FROM st",
    "staleness_status": f"WITH {SCAN}, {STATE} SELECT st.source, {FRESH} AS status FROM st LEFT JOIN scan ON scan.source = st.source",
    "store_status": f"WITH {SCAN}, {STATE} SELECT count(*) AS documents, coalesce(sum(chunks), 0)::BIGINT AS chunks, coalesce(max(st.mtime), 0) AS last_mtime, count(*) FILTER (WHERE {FRESH} = 'STALE') AS stale FROM st LEFT JOIN scan ON scan.source = st.source",
    "stored_bytes": "SELECT bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN (bytes // 1024) || ' KB' ELSE (bytes // 1048576) || ' MB' END AS shown FROM (SELECT sum(strlen(content))::BIGINT AS bytes FROM chunks WHERE content IS NOT NULL)",
    "incremental_anti_join": f"WITH {SCAN}, {STATE} SELECT source, mtime FROM scan WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source = scan.source AND st.mtime = scan.mtime)",
    "unchanged_predicate": f"WITH {SCAN}, {STATE} SELECT scan.source, {SAME} AS unchanged FROM scan LEFT JOIN st ON st.source = scan.source",
    "ingest_actions": f"WITH {SCAN}, {STATE}, {ACT} SELECT source, action FROM act",
    "ingest_counters": f"WITH {SCAN}, {STATE}, {ACT} SELECT " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS \"{a}\"" for a in ("add", "update", "skip", "failed")) + " FROM act",
    "reingest_plan": f"WITH {SCAN}, {STATE}, {RE} SELECT source, status, action FROM re",
    "reingest_counters": f"WITH {SCAN}, {STATE}, {RE} SELECT count(*) FILTER (WHERE status = 'STALE') AS stale, " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS \"{a}\"" for a in ("replace", "touch", "skip", "keep")) + " FROM re",
    "http_status_filter": "SELECT kind, count(*) AS n FROM source_scan WHERE status_code IS NULL OR status_code < 400 GROUP BY 1",
    "content_hash": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "dedupe_by_hash": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "repeated_chunk_ids": "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "latest_versions": "SELECT source, chunk_index, arg_max(chunk_id, (mtime, chunk_id)) AS chunk_id, count(DISTINCT chunk_id) AS versions FROM chunks WHERE source IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1, 2",
    "chunk_index_gaps": "SELECT source, chunk_index AS after, nxt AS before FROM (SELECT source, chunk_index, lead(chunk_index) OVER (PARTITION BY source ORDER BY chunk_index) AS nxt FROM (SELECT DISTINCT source, chunk_index FROM chunks WHERE source IS NOT NULL AND chunk_index IS NOT NULL)) WHERE nxt > chunk_index + 1",
    "empty_output_sources": f"WITH {SCAN} SELECT source FROM scan WHERE source NOT IN (SELECT source FROM chunks WHERE length(trim(content, ' ')) > 0 AND source IS NOT NULL)",
    "vanished_sources": f"WITH {STATE} SELECT source, chunks FROM st WHERE source NOT IN (SELECT source FROM source_scan WHERE source IS NOT NULL)",
    "delete_sources": r"SELECT lower(regexp_extract(regexp_replace(string_split(source, '/')[-1], '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n FROM chunks WHERE source IS NULL OR NOT starts_with(source, '/srv/mirror/') GROUP BY 1",
    "delete_counts": "SELECT source, count(*) AS removed FROM chunks WHERE starts_with(source, '/srv/mirror/') GROUP BY 1",
    "point_lookup": "SELECT DISTINCT chunk_index, chunk_id, length(content) AS n_chars, heading_title FROM chunks WHERE source = '/srv/corpus/handbook/operations-journal.md'",
    "run_summary": "SELECT r.run_id, run_status, coalesce(sources, 0) AS sources, coalesce(no_hash, 0) AS no_hash, strftime(make_timestamp(started_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS started FROM ingest_runs r LEFT JOIN (SELECT run_id, count(DISTINCT source) AS sources, count(*) FILTER (WHERE content_hash IS NULL) AS no_hash FROM (SELECT DISTINCT * FROM ingest_log) GROUP BY 1) l ON l.run_id = r.run_id",
    "late_arrivals": "SELECT kind, count(*) AS n, count(DISTINCT source) AS sources FROM source_scan WHERE arrived_at > scanned_at + INTERVAL 1 DAY GROUP BY 1",
}

SQL["store_bm25"] = search.bm25_sql(5) + "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm"
