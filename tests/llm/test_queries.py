"""The registered training-data queries on the smallest tables: same rows as their SQL, stated columns for the others."""

import duckdb
import pytest

from chunkwise.llm.queries import QUERIES
from chunkwise.llm.sql import SQL

COLUMNS = {
    "p1_found": ["chunk_id_a", "chunk_id_b"], "p2_found": ["query_id", "chunk_id"], "p3_found": ["decl_id"], "p4_found": ["chunk_id"], "p5_found": ["chunk_id"],
    "p6_found": ["chunk_id_a", "chunk_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = sorted(tuple(r) for r in df.collect()) if name in SQL else df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in SQL:
        con = duckdb.connect()
        for t in ("chunks", "search_scores"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        rel = con.execute(SQL[name])
        names = [c[0] for c in rel.description]
        want = sorted(tuple(r[names.index(c)] for c in df.columns) for r in rel.fetchall())
        assert got == want
    if name.endswith("_found"):
        assert len({tuple(r) for r in got}) == len(got)
