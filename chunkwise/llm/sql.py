"""DuckDB statements that give the results of the registered training-data queries."""

P1_PAIRS = r"""
WITH t AS (
    SELECT DISTINCT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL
), g AS (
    SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
    FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), n AS (SELECT chunk_id, count(*) AS c FROM g GROUP BY 1),
p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
"""

SQL = {
    "p1_found": P1_PAIRS + """
SELECT x AS chunk_id_a, y AS chunk_id_b FROM p JOIN n nx ON nx.chunk_id = x JOIN n ny ON ny.chunk_id = y
WHERE p.c * 2 >= nx.c + ny.c - p.c""",
}

SQL["p1_groups"] = P1_PAIRS.replace("WITH t AS", "WITH RECURSIVE t AS") + """,
near AS (
    SELECT x, y, p.c = nx.c AND p.c = ny.c AS same FROM p JOIN n nx ON nx.chunk_id = x JOIN n ny ON ny.chunk_id = y
    WHERE p.c * 2 >= nx.c + ny.c - p.c
), edges AS (SELECT x, y, same FROM near UNION ALL SELECT y, x, same FROM near),
reach(chunk_id, other) AS (
    SELECT chunk_id, chunk_id FROM chunks WHERE chunk_id IS NOT NULL
    UNION SELECT reach.chunk_id, edges.y FROM reach JOIN edges ON edges.x = reach.other
)
SELECT chunk_id, least(chunk_id, (SELECT min(y) FROM edges WHERE edges.x = r.chunk_id AND same)) AS class_id, min(other) AS group_id
FROM reach r GROUP BY chunk_id"""

BORDA = """
WITH one AS (
    SELECT query_id, chunk_id, search_mode, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS score
    FROM search_scores WHERE search_mode IN ('bm25', 'embedding', 'rerank') AND query_id IS NOT NULL AND chunk_id IS NOT NULL
    GROUP BY 1, 2, 3
), items AS (SELECT DISTINCT query_id, chunk_id FROM one),
grid AS (
    SELECT i.query_id, i.chunk_id, m.search_mode, o.score
    FROM items i CROSS JOIN (VALUES ('bm25'), ('embedding'), ('rerank')) m(search_mode)
    LEFT JOIN one o ON o.query_id = i.query_id AND o.chunk_id = i.chunk_id AND o.search_mode = m.search_mode
), ranked AS (
    SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id, search_mode) AS n,
           2 * rank() OVER (PARTITION BY query_id, search_mode ORDER BY score DESC NULLS LAST)
           + count(*) OVER (PARTITION BY query_id, search_mode, score) - 1 AS rank2
    FROM grid
), total AS (
    SELECT query_id, chunk_id, sum(2 * n)::BIGINT - sum(rank2)::BIGINT AS points2, sum(rank2)::BIGINT AS rank_sum2
    FROM ranked GROUP BY 1, 2
)
"""
SQL["p2_ranking"] = BORDA + "SELECT * FROM total"
SQL["p2_found"] = BORDA + """
SELECT query_id, chunk_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points2 DESC, chunk_id) AS place FROM total
) WHERE place <= 5"""

SQL["p5_found"] = "SELECT DISTINCT chunk_id FROM chunks WHERE length(content) > 2000"
