"""Queries over smaller functions: exact token counts, display paths, maps, clusters of positions, element dumps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwise.functions.tokens import bpe_counter
from chunkwise.functions.text import excerpt
from chunkwise.operators.store import hashed_vector
from chunkwise.session import table


def _docs(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL")


def bpe_token_counts(spark, d):
    """Exact token counts of a public vocabulary, over Arrow batches."""
    def run(texts: pd.Series) -> pd.Series:
        enc = bpe_counter()
        return pd.Series([len(x) for x in enc.encode_ordinary_batch(texts.tolist(), num_threads=1)])

    return _docs(spark, d).select("doc_id", F.pandas_udf(run, "bigint")("text").alias("tokens"))


def relative_paths(spark, d):
    """Source paths relative to a root, with a mark for URLs."""
    s = table(spark, d, "chunks").where("source IS NOT NULL").select("source").distinct()
    return s.select("source", F.concat(F.regexp_replace("source", "^/srv/", ""), F.when(F.col("source").rlike("^https?://"), " [url]").otherwise("")).alias("shown"))


def metadata_merge(spark, d):
    """Metadata of chunks: a base map without its file name, joined with heading and language."""
    c = table(spark, d, "chunks").where("chunk_id IS NOT NULL AND source IS NOT NULL").dropDuplicates(["chunk_id"])
    base = F.create_map(F.lit("filename"), F.element_at(F.split("source", "/"), -1), F.lit("kind"), F.lit("chunk"))
    kept = F.map_filter(base, lambda k, v: k != "filename")
    merged = F.map_concat(kept, F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("und")), F.lit("title"), F.coalesce("heading_title", F.lit(""))))
    entries = F.transform(F.array_sort(F.map_keys(merged)), lambda k: F.concat(k, F.lit("="), F.element_at(merged, k)))
    return c.select("chunk_id", F.array_join(entries, ";").alias("metadata"))


def position_clusters(spark, d):
    """Clusters of prices within a part's lines: a gap above 1000 opens a new one."""
    w = Window.partitionBy("l_partkey").orderBy("l_extendedprice")
    gap = F.col("l_extendedprice") - F.lag("l_extendedprice").over(w) > 1000
    rows = table(spark, d, "lineitem").select("l_partkey", F.coalesce(gap.cast("int"), F.lit(0)).alias("g"))
    return rows.groupBy("l_partkey").agg((F.sum("g") + 1).alias("clusters"))


def body_margin(spark, d):
    """Per order the smallest quantity that occurs at least twice, else the most frequent (smallest of equals)."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("l_orderkey").agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("l_quantity"))), F.max_by(-F.col("l_quantity"), F.struct("n", -F.col("l_quantity"))) * -1).alias("margin"))


def element_xml(spark, d):
    """Dump of positioned elements as XML lines."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.format_string('<text page="%d" y="%d">%d</text>', F.floor((F.col("l_linenumber") - 1) / 3) + 1, 100 + 14 * F.col("l_linenumber"), "l_partkey").alias("xml"))


def excerpts(spark, d):
    return _docs(spark, d).select("doc_id", excerpt("text").alias("excerpt"))


def hashed_embeddings(spark, d):
    """Default embedder on the questions: length of each vector (1 where there is a word) and its dimensions."""
    v = table(spark, d, "queries").select("query_id", hashed_vector(F.col("question")).alias("v"))
    return v.select("query_id", F.size("v").cast("bigint").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


def union_of_sources(spark, d):
    """Sources of the store and of the scan, told apart."""
    a = table(spark, d, "chunks").select("source", F.lit(1).alias("stored"), F.lit(0).alias("seen"))
    b = table(spark, d, "source_scan").select("source", F.lit(0).alias("stored"), F.lit(1).alias("seen"))
    return a.unionByName(b).where("source IS NOT NULL").groupBy("source").agg(F.max("stored").alias("stored"), F.max("seen").alias("seen"))


def tabular_batches(spark, d):
    """Parts per brand and the batches of ten rows they make."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return p.select("p_brand", "n", F.ceil(F.col("n") / 10).cast("bigint").alias("batches"))


NAMES = (bpe_token_counts, relative_paths, metadata_merge, position_clusters, body_margin, element_xml, excerpts, hashed_embeddings, union_of_sources, tabular_batches)
QUERIES = {f.__name__: f for f in NAMES}
__all__ = ["QUERIES", "SQL"]

SQL = {
    "relative_paths": "SELECT source, regexp_replace(source, '^/srv/', '') || CASE WHEN regexp_matches(source, '^https?://') THEN ' [url]' ELSE '' END AS shown FROM (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL)",
    "metadata_merge": "SELECT chunk_id, 'kind=chunk;lang=' || coalesce(lang, 'und') || ';title=' || coalesce(heading_title, '') AS metadata FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL AND source IS NOT NULL)",
    "position_clusters": "SELECT l_partkey, (sum(g) + 1)::BIGINT AS clusters FROM (SELECT l_partkey, coalesce((l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) > 1000)::INT, 0) AS g FROM lineitem) GROUP BY 1",
    "body_margin": "SELECT l_orderkey, coalesce(min(l_quantity) FILTER (WHERE n >= 2), arg_max(l_quantity, (n, -l_quantity))) AS margin FROM (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "element_xml": "SELECT l_orderkey, l_linenumber, '<text page=\"' || ((l_linenumber - 1) // 3 + 1) || '\" y=\"' || (100 + 14 * l_linenumber) || '\">' || l_partkey || '</text>' AS xml FROM lineitem",
    "excerpts": "SELECT doc_id, substring(text, 1, 200) AS excerpt FROM documents WHERE text IS NOT NULL",
    "union_of_sources": "SELECT source, max(stored)::INT AS stored, max(seen)::INT AS seen FROM (SELECT source, 1 AS stored, 0 AS seen FROM chunks UNION ALL SELECT source, 0, 1 FROM source_scan) WHERE source IS NOT NULL GROUP BY 1",
    "tabular_batches": "SELECT p_brand, count(*) AS n, ceil(count(*) / 10.0)::BIGINT AS batches FROM part GROUP BY 1",
}
