"""Queries over the interval ledger: what must be processed now."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwise.operators import intervals
from chunkwise.session import table


def p7_found(spark, d):
    return p7_changed(spark, d).select("source")


def p7_changed(spark, d):
    return intervals.changed_sources(table(spark, d, "source_scan"), table(spark, d, "ingest_log"), table(spark, d, "ingest_runs"))


def p7_committed_runs(spark, d):
    return intervals.committed_runs(table(spark, d, "ingest_runs"))


def p7_gaps(spark, d):
    """Scan numbers not yet covered when every scan row of a source that a good run stored counts as processed."""
    scan = table(spark, d, "source_scan")
    done = scan.join(table(spark, d, "ingest_log").select("source").distinct(), "source", "left_semi")
    return intervals.subtract_intervals(intervals.points(scan, "scan_id"), intervals.points(done, "scan_id"))


QUERIES = {f.__name__: f for f in (p7_found, p7_changed, p7_committed_runs, p7_gaps)}

CHANGED = """
WITH cur AS (
    SELECT * FROM source_scan
    WHERE content_hash IS NOT NULL AND coalesce(status_code, 0) < 400 AND source IS NOT NULL AND scanned_at IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY scanned_at DESC, scan_id DESC) = 1
), st AS (
    SELECT l.* FROM ingest_log l JOIN ingest_runs r ON r.run_id = l.run_id AND r.run_status = 'ok' WHERE l.source IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY l.source ORDER BY l.run_id DESC, l.ingest_time DESC NULLS LAST, l.mtime DESC NULLS LAST, l.content_hash DESC NULLS LAST) = 1
), ch AS (
    SELECT cur.source, cur.content_hash, cur.scan_id, st.content_hash AS stored_hash
    FROM cur LEFT JOIN st ON st.source = cur.source
    WHERE st.source IS NULL OR st.content_hash IS NULL OR st.content_hash <> cur.content_hash
)
"""

ISLANDS = "SELECT min(x)::BIGINT AS lo, max(x)::BIGINT AS hi FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM (SELECT DISTINCT {0} AS x FROM {1})) GROUP BY g"

SQL = {
    "p7_found": CHANGED + "SELECT source FROM ch",
    "p7_changed": CHANGED + "SELECT * FROM ch",
    "p7_committed_runs": ISLANDS.format("run_id", "ingest_runs WHERE run_status = 'ok'"),
    "p7_gaps": ISLANDS.format("scan_id", "source_scan WHERE source IS NULL OR source NOT IN (SELECT source FROM ingest_log WHERE source IS NOT NULL)"),
}
