"""Queries over headings, blocks and chunkers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from chunkwise.functions import text as tx
from chunkwise.operators import blocks, chunking
from chunkwise.session import table


def _docs(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL")


def heading_path_split(spark, d):
    s = blocks.heading_sections(_docs(spark, d), "doc_id", "text")
    return s.select("doc_id", "section", "heading_level", "heading_title", tx.path_string("heading_path").alias("path"), F.length("body").cast("bigint").alias("n_chars"))


def chunk_heading_sections(spark, d):
    """Heading path of chunks that hold several headings, from the store's own ``#`` lines."""
    c = table(spark, d, "chunks").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    s = blocks.heading_sections(c, "chunk_id", "content")
    return s.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("sections"), F.max("heading_level").alias("deepest"))


def front_matter_strip(spark, d):
    wrapped = F.concat(F.lit("---\ntitle: "), F.coalesce("source", F.lit("none")), F.lit("\n---\n"), "text")
    return _docs(spark, d).select("doc_id", F.sha2(tx.strip_front_matter(wrapped), 256).alias("digest"))


def layout_block_kinds(spark, d):
    """Fence-aware blocks of every document, in order."""
    def run(frames):
        for pdf in frames:
            rows = [(i, n, k, t.count("\n") + 1, len(t)) for i, x in zip(pdf["doc_id"], pdf["text"]) for n, (k, t, _) in enumerate(blocks.layout_blocks(x))]
            yield pd.DataFrame(rows, columns=["doc_id", "block", "kind", "n_lines", "n_chars"])

    return _docs(spark, d).select("doc_id", "text").mapInPandas(run, "doc_id bigint, block int, kind string, n_lines int, n_chars int")


def token_window_chunks(spark, d):
    return chunking.word_windows(_docs(spark, d), "doc_id", "text", 100)


def overlap_window_chunks(spark, d):
    return chunking.word_windows(_docs(spark, d), "doc_id", "text", 100, 20)


def greedy_pack_chunks(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    weights = F.transform(lines, lambda x: F.size(F.split(F.trim(x), " +")))
    rows = _docs(spark, d).select("doc_id", F.posexplode(chunking.pack_lines(lines, weights, 60)).alias("chunk_index", "chunk"))
    return rows.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha2("chunk", 256).alias("digest"))


def table_chunks_nation(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return chunking.table_chunks_native(n, ["r_name"], ["n_nationkey"], ["n_nationkey", "n_name"], 22)


def table_chunks_orders(spark, d):
    """Orders of each customer as tables of whole rows within 60 words."""
    o = table(spark, d, "orders")
    got = chunking.table_chunks_native(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"], 60)
    return got.select("o_custkey", "chunk_index", "n_rows", F.sha2("chunk", 256).alias("digest"))


def markdown_bpe_chunks(spark, d):
    return chunking.to_chunks(_docs(spark, d), "doc_id", "text", 200, 100)


def markdown_word_chunks(spark, d):
    return chunking.to_chunks(_docs(spark, d), "doc_id", "text", 120, 0, "words")


def heading_prefix(spark, d):
    c = table(spark, d, "chunks").where("heading_title IS NOT NULL AND heading_level IS NOT NULL").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", tx.heading_prefix("heading_level", "heading_title").alias("prefix"), tx.path_string("heading_path").alias("path"))


def asciidoc_code_fences(spark, d):
    made = F.concat(F.lit("= Title\n-----\n"), "text", F.lit("\n-----\n"))
    return _docs(spark, d).select("doc_id", F.sha2(tx.asciidoc_fences(made), 256).alias("digest"))


NAMES = (heading_path_split, chunk_heading_sections, front_matter_strip, layout_block_kinds, token_window_chunks, overlap_window_chunks, greedy_pack_chunks, table_chunks_nation, table_chunks_orders, markdown_bpe_chunks, markdown_word_chunks, heading_prefix, asciidoc_code_fences)
QUERIES = {f.__name__: f for f in NAMES}

HEADS = r"""
WITH src AS ({src}), l AS (
    SELECT id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM src)
), m AS (
    SELECT id, pos, line, CASE WHEN regexp_matches(line, '^(#{{1,6}})\s+(.+)$') THEN len(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 1)) END AS lv,
           trim(regexp_extract(line, '^(#{{1,6}})\s+(.+)$', 2), ' ') AS title FROM l
), s AS (SELECT *, count(lv) OVER (PARTITION BY id ORDER BY pos) AS section FROM m),
h AS (SELECT id, section, lv, title FROM s WHERE lv IS NOT NULL),
alive AS (
    SELECT a.id, a.section, b.lv, b.title, b.section AS at FROM h a JOIN h b ON a.id = b.id AND b.section <= a.section AND b.lv <= a.lv
    WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.id = a.id AND c.section > b.section AND c.section <= a.section AND c.lv <= b.lv)
), p AS (SELECT id, section, string_agg(title, ' > ' ORDER BY lv) AS path FROM alive GROUP BY 1, 2),
b AS (SELECT id, section, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\A\s+|\s+\z', '', 'g') AS body FROM s WHERE lv IS NULL GROUP BY 1, 2)
"""
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def _windows(size, overlap):
    step = size - overlap
    return (
        f"SELECT doc_id, i AS chunk_index, len(w[i * {step} + 1 : i * {step} + {size}])::BIGINT AS n_words, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS chunk FROM ("
        f"SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - {overlap}) / {step}.0)::BIGINT))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)"
    )


def _pack(src, budget, head_words=0):
    """Greedy packing as a recursive query over (id, pos, line, n)."""
    return (
        f"WITH RECURSIVE items AS ({src}), r AS (SELECT id, pos, n AS used, 0::BIGINT AS chunk FROM items WHERE pos = 1 "
        f"UNION ALL SELECT i.id, i.pos, CASE WHEN r.used + i.n <= {budget - head_words} THEN r.used + i.n ELSE i.n END, CASE WHEN r.used + i.n <= {budget - head_words} THEN r.chunk ELSE r.chunk + 1 END "
        "FROM r JOIN items i ON i.id = r.id AND i.pos = r.pos + 1), packed AS (SELECT r.id, r.chunk AS chunk_index, string_agg(i.line, chr(10) ORDER BY i.pos) AS body, count(*) AS n_rows FROM r JOIN items i ON i.id = r.id AND i.pos = r.pos GROUP BY 1, 2) "
    )


PLAIN_KIND = r"CASE WHEN regexp_matches(line, '\|') THEN 'table' WHEN regexp_matches(line, '^([-*+] |\d+\. )') THEN 'bullets' WHEN regexp_matches(line, '^>( |$)') THEN 'quote' WHEN regexp_matches(line, '^\s*(-{3,}|_{3,}|\*{3,})\s*$') THEN 'rule' WHEN regexp_matches(line, '^\s*$') THEN 'blank' ELSE 'paragraph' END"
ORDER_ROWS = "SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, line, len(string_split(line, ' ')) AS n FROM (SELECT o_custkey, o_orderkey, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line FROM orders)"
NATION_ROWS = "SELECT r_name AS id, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS pos, line, len(string_split(line, ' ')) AS n FROM (SELECT r_name, n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey)"
LINE_ROWS = r"SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS pos, line, len(regexp_split_to_array(trim(line, ' '), ' +')) AS n FROM (SELECT doc_id, unnest(range(0, len(ls))) AS p, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE trim(line, ' ') <> ''"
N = "chr(10)"
SQL = {
    "heading_path_split": HEADS.format(src="SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL") + "SELECT b.id AS doc_id, b.section, h.lv::INT AS heading_level, h.title AS heading_title, coalesce(p.path, '') AS path, length(b.body) AS n_chars FROM b LEFT JOIN h USING (id, section) LEFT JOIN p USING (id, section) WHERE length(b.body) > 0",
    "chunk_heading_sections": HEADS.format(src="SELECT DISTINCT chunk_id AS id, content AS text FROM chunks WHERE content IS NOT NULL") + "SELECT b.id AS chunk_id, count(*) AS sections, max(h.lv)::INT AS deepest FROM b LEFT JOIN h USING (id, section) WHERE length(b.body) > 0 GROUP BY 1",
    "front_matter_strip": "SELECT doc_id, sha256(regexp_replace(text, '\\A\\s+', '')) AS digest FROM documents WHERE text IS NOT NULL",
    "token_window_chunks": _windows(100, 0),
    "overlap_window_chunks": _windows(100, 20),
    "greedy_pack_chunks": _pack(LINE_ROWS, 60) + "SELECT id AS doc_id, chunk_index, sha256(body) AS digest FROM packed",
    "table_chunks_nation": _pack(NATION_ROWS, 22, 10) + f"SELECT id AS r_name, chunk_index, n_rows, '| n_nationkey | n_name |' || {N} || '| --- | --- |' || {N} || body AS chunk FROM packed",
    "table_chunks_orders": _pack(ORDER_ROWS, 60, 14) + f"SELECT id AS o_custkey, chunk_index, n_rows, sha256('| o_orderkey | o_orderstatus | o_orderpriority |' || {N} || '| --- | --- | --- |' || {N} || body) AS digest FROM packed",
    "heading_prefix": "SELECT DISTINCT chunk_id, repeat('#', heading_level) || ' ' || heading_title AS prefix, array_to_string(heading_path, ' > ') AS path FROM chunks WHERE heading_title IS NOT NULL AND heading_level IS NOT NULL",
    "asciidoc_code_fences": "SELECT doc_id, sha256(regexp_replace('= Title' || chr(10) || '-----' || chr(10) || text || chr(10) || '-----' || chr(10), '(?m)^[ \\t]*-{4,}[ \\t]*$', '```', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
}
