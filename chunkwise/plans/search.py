"""Retrieval queries over the store and the questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chunkwise.functions import text, tokens
from chunkwise.operators import search
from chunkwise.session import table


def _t(spark, d):
    return table(spark, d, "chunks"), table(spark, d, "queries")


def _r(df, digits=6, cols=("score",)):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def bm25_topk(spark, d):
    return _r(search.bm25(*_t(spark, d)), cols=("raw", "score"))


def bm25_normalized_min_score(spark, d):
    return _r(search.bm25(*_t(spark, d), k=10, min_score=0.8)).select("query_id", "rank", "chunk_id", "score")


def bm25_term_stats(spark, d):
    post = search.postings(search.documents_of(table(spark, d, "chunks")))
    return search.term_stats(post)


def bm25_corpus_stats(spark, d):
    return search.corpus_stats(search.documents_of(table(spark, d, "chunks"))).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_question_terms(spark, d):
    return search.question_terms(table(spark, d, "queries"))


def analyzer_standard(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(tokens.standard("text")).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(tokens.standard("text"), " "), 256).alias("digest"))


def analyzer_english(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    words = tokens.english_words("text")
    return docs.select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("digest"))


def analyzer_english_stems(spark, d):
    return table(spark, d, "queries").select("query_id", F.array_join(tokens.english("question"), " ").alias("stems"))


def bm25_english(spark, d):
    return _r(search.bm25(*_t(spark, d), analyzer=tokens.english)).select("query_id", "rank", "chunk_id", "score")


def knn_topk(spark, d):
    return _r(search.knn(*_t(spark, d)))


def knn_min_score(spark, d):
    return _r(search.knn(*_t(spark, d), k=10, min_score=0.75))


def knn_embeddings(spark, d):
    """Every fiftieth vector asks, all vectors answer."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return _r(search.knn(e, q, k=4, id_col="vec_id", vector="embedding"))


def cosine_native(spark, d):
    c, q = _t(spark, d)
    pairs = table(spark, d, "search_scores").where("search_mode = 'embedding'").select("query_id", "chunk_id").distinct()
    rows = pairs.join(q.where("qvec IS NOT NULL").select("query_id", "qvec"), "query_id").join(search.live_chunks(c).where(search.usable_vector("vector", 64)).select("chunk_id", "vector"), "chunk_id")
    return rows.select("query_id", "chunk_id", F.round((1 + text.cosine("qvec", "vector")) / 2, 6).alias("score"))


def hybrid_rrf(spark, d):
    return _r(search.hybrid(*_t(spark, d)))


def rrf_fuse_scores(spark, d):
    """Fusion of the stored bm25 and embedding score lists."""
    return _r(search.fuse(_ranked(spark, d, "bm25"), _ranked(spark, d, "embedding"), 5))


def rrf_single_list(spark, d):
    """One leg empty: every item of the other has the worst rank there."""
    left = _ranked(spark, d, "bm25")
    return _r(search.fuse(left, left.where("false"), 5)).select("query_id", "rank", "chunk_id", "score")


def _ranked(spark, d, mode, most=10):
    s = table(spark, d, "search_scores").where((F.col("search_mode") == mode) & F.col("score").isNotNull() & ~F.isnan("score"))
    one = s.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def score_mode_max_normalized(spark, d):
    s = table(spark, d, "search_scores").where("search_mode = 'bm25' AND score IS NOT NULL AND NOT isnan(score)").select("query_id", "chunk_id", "score").distinct()
    return s.select("query_id", "chunk_id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("score"))


def rerank_lexical(spark, d):
    c, q = _t(spark, d)
    return _r(search.rerank(search.bm25(c, q, 15), q, c, 5))


def rerank_stored_scores(spark, d):
    """The stored reranker scores reorder the ten best of the embedding list; the rest of the list falls away."""
    cand = _ranked(spark, d, "embedding").select("query_id", "chunk_id", F.col("rank").alias("before"))
    s = table(spark, d, "search_scores").where("search_mode = 'rerank' AND score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    rows = cand.join(s, ["query_id", "chunk_id"]).withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return rows.select("query_id", "rank", "chunk_id", "before", F.round("score", 6).alias("score"))


def filtered_search(spark, d):
    """Metadata join before the ranking: only chunks of German or French text."""
    c, q = _t(spark, d)
    return _r(search.bm25(c.where("lang IN ('de', 'fr')"), q, 3)).select("query_id", "rank", "chunk_id", "score")


def chunk_neighbors_range_join(spark, d):
    c = table(spark, d, "chunks")
    hits = _ranked(spark, d, "rerank", 3).join(search.live_chunks(c).select("chunk_id", "source", "chunk_index"), "chunk_id")
    return search.neighbours_of(hits, c, 1).select("query_id", "source", "chunk_index", "chunk_id")


def chunk_range_window(spark, d):
    return search.chunk_range(table(spark, d, "chunks"), "/srv/corpus/handbook/operations-journal.md", 9, 2).select("chunk_index", "chunk_id", "heading_title")


def chunk_neighbors_window(spark, d):
    """Previous and next chunk of the same source by position."""
    c = search.live_chunks(table(spark, d, "chunks")).where("chunk_index IS NOT NULL AND source IS NOT NULL")
    w = Window.partitionBy("source").orderBy("chunk_index", "chunk_id")
    return c.select("chunk_id", F.lag("chunk_id").over(w).alias("previous"), F.lead("chunk_id").over(w).alias("following"))


def _results(spark, d):
    c = search.live_chunks(table(spark, d, "chunks")).select("chunk_id", "source", "content")
    return _ranked(spark, d, "rerank", 3).join(c, "chunk_id").select("query_id", "rank", "source", "score", "content")


def rag_context(spark, d):
    return search.prompt_context(_results(spark, d).where("source IS NOT NULL"))


def rag_excerpts(spark, d):
    return _r(search.source_references(_results(spark, d)))


def rag_answer_passthrough(spark, d):
    return search.answer(_results(spark, d).where("source IS NOT NULL"), table(spark, d, "queries"))


def _turns(spark, d):
    """Questions of a scenario as turns of a conversation; every fourth got no answer."""
    q = table(spark, d, "queries")
    answered = F.when(F.col("query_id") % 4 != 0, F.concat(F.lit("answer "), F.col("query_id").cast("string")))
    return q.select(F.coalesce("scenario", F.lit("none")).alias("conv_id"), F.col("query_id").alias("turn"), "question", answered.alias("answer"))


def conversation_history(spark, d):
    h = search.conversation_history(_turns(spark, d))
    return h.select("conv_id", "turn", F.size("history").cast("bigint").alias("n_history"), F.array_join(F.transform("history", lambda x: x["turn"].cast("string")), ",").alias("turns"))


NAMES = (
    bm25_topk, bm25_normalized_min_score, bm25_term_stats, bm25_corpus_stats, bm25_question_terms, analyzer_standard, analyzer_english, analyzer_english_stems, bm25_english,
    knn_topk, knn_min_score, knn_embeddings, cosine_native, hybrid_rrf, rrf_fuse_scores, rrf_single_list, score_mode_max_normalized, rerank_lexical, rerank_stored_scores, filtered_search,
    chunk_neighbors_range_join, chunk_range_window, chunk_neighbors_window, rag_context, rag_excerpts, rag_answer_passthrough, conversation_history,
)
QUERIES = {f.__name__: f for f in NAMES}

CHUNKS = "SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL"
TERMS = r"regexp_extract_all(translate(lower({0}), 'ς', 'σ'), '[\p{{L}}\p{{N}}_]+')"  # a format string
DOCS = "docs AS (SELECT chunk_id, terms, len(terms) AS dl FROM (SELECT chunk_id, " + TERMS.format("content") + " AS terms FROM (" + CHUNKS + ") WHERE content IS NOT NULL@where@) WHERE len(terms) > 0)"
BM25 = (
    "WITH " + DOCS + ", stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs), "
    "q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(" + TERMS.format("question") + ") AS term FROM queries) GROUP BY 1, 2), "
    "post AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, dl, unnest(terms) AS term FROM docs) GROUP BY 1, 2), "
    "df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), "
    "raw AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw "
    "FROM q JOIN df USING (term) JOIN post USING (term) CROSS JOIN stats GROUP BY 1, 2), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM raw), "
    "bm AS (SELECT query_id, rank::INT AS rank, chunk_id, raw, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM ranked WHERE rank <= @k@) "
)


def bm25_sql(k: int, where: str = "") -> str:
    return BM25.replace("@k@", str(k)).replace("@where@", where)


OK_VECTOR = "{0} IS NOT NULL AND len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"
KNN = (
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, {id})::INT AS rank, {id}, score FROM ("
    "SELECT q.query_id, c.{id}, (1 + list_cosine_similarity(q.{qv}::DOUBLE[], c.{v}::DOUBLE[])) / 2 AS score "
    "FROM (SELECT * FROM {q} WHERE " + OK_VECTOR.format("{qv}") + ") q CROSS JOIN (SELECT * FROM {c} WHERE " + OK_VECTOR.format("{v}") + ") c)"
)
KNN_CHUNKS = KNN.format(id="chunk_id", qv="qvec", v="vector", q="queries", c=f"({CHUNKS})")


def _ranked_sql(mode, most=10):
    return f"SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, max(score) AS score FROM search_scores WHERE search_mode = '{mode}' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)) WHERE rank <= {most}"


FUSE = (
    "fu AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS u FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS left_rank, b.rank AS right_rank "
    "FROM lft a FULL JOIN rgt b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)), "
    "sc AS (SELECT *, (1::DOUBLE / (60 + coalesce(left_rank, u + 1)) + 1::DOUBLE / (60 + coalesce(right_rank, u + 1))) / (2::DOUBLE / 61) AS score FROM fu), "
    "fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, left_rank NULLS LAST, right_rank NULLS LAST, chunk_id)::INT AS rank, chunk_id, round(score, 6) AS score, left_rank::INT AS left_rank, right_rank::INT AS right_rank FROM sc) "
)
STOP = ", ".join(f"'{w}'" for w in tokens.STOP_WORDS)
ENGLISH = r"list_filter(regexp_extract_all(regexp_replace(translate(lower(text), 'ς', 'σ'), '[''’]s\b', '', 'g'), '[\p{L}\p{N}_]+'), lambda t: t NOT IN (" + STOP + "))"
RESULTS = f"SELECT r.query_id, r.rank, c.source, r.score, c.content FROM ({_ranked_sql('rerank', 3)}) r JOIN ({CHUNKS}) c USING (chunk_id)"
CONTEXT = "SELECT query_id, string_agg('<document source=\"' || source || '\">' || chr(10) || coalesce(content, '') || chr(10) || '</document>', chr(10) || chr(10) ORDER BY rank) AS context FROM (" + RESULTS + ") WHERE source IS NOT NULL GROUP BY 1"

SQL = {
    "bm25_topk": bm25_sql(5) + "SELECT query_id, rank, chunk_id, round(raw, 6) AS raw, round(score, 6) AS score FROM bm",
    "bm25_normalized_min_score": bm25_sql(10) + "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm WHERE score >= 0.8",
    "bm25_term_stats": "WITH " + DOCS.replace("@where@", "") + " SELECT term, count(DISTINCT chunk_id) AS df, count(*)::BIGINT AS cf FROM (SELECT chunk_id, unnest(terms) AS term FROM docs) GROUP BY 1",
    "bm25_corpus_stats": "WITH " + DOCS.replace("@where@", "") + " SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM docs",
    "bm25_question_terms": "SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(" + TERMS.format("question") + ") AS term FROM queries) GROUP BY 1, 2",
    "analyzer_standard": "SELECT doc_id, len(" + TERMS.format("text") + ")::BIGINT AS n_tokens, sha256(array_to_string(" + TERMS.format("text") + ", ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "analyzer_english": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {ENGLISH} AS t FROM documents WHERE text IS NOT NULL)",
    "knn_topk": f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({KNN_CHUNKS}) WHERE rank <= 5",
    "knn_min_score": f"SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({KNN_CHUNKS}) WHERE rank <= 10 AND score >= 0.75",
    "knn_embeddings": "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (" + KNN.format(id="vec_id", qv="qvec", v="embedding", q="(SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0)", c="embeddings") + ") WHERE rank <= 4",
    "cosine_native": f"SELECT s.query_id, s.chunk_id, round((1 + list_cosine_similarity(q.qvec::DOUBLE[], c.vector::DOUBLE[])) / 2, 6) AS score FROM (SELECT DISTINCT query_id, chunk_id FROM search_scores WHERE search_mode = 'embedding') s JOIN (SELECT * FROM queries WHERE qvec IS NOT NULL) q USING (query_id) JOIN (SELECT * FROM ({CHUNKS}) WHERE {OK_VECTOR.format('vector')}) c USING (chunk_id)",
    "hybrid_rrf": bm25_sql(10) + f", lft AS (SELECT * FROM bm), rgt AS (SELECT * FROM ({KNN_CHUNKS}) WHERE rank <= 10), {FUSE} SELECT * FROM fused WHERE rank <= 5",
    "rrf_fuse_scores": f"WITH lft AS ({_ranked_sql('bm25')}), rgt AS ({_ranked_sql('embedding')}), {FUSE} SELECT * FROM fused WHERE rank <= 5",
    "rrf_single_list": f"WITH lft AS ({_ranked_sql('bm25')}), rgt AS (SELECT * FROM lft WHERE false), {FUSE} SELECT query_id, rank, chunk_id, score FROM fused WHERE rank <= 5",
    "score_mode_max_normalized": "SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM (SELECT DISTINCT query_id, chunk_id, score FROM search_scores WHERE search_mode = 'bm25' AND score IS NOT NULL AND NOT isnan(score))",
    "rerank_lexical": bm25_sql(15) + f", j AS (SELECT bm.query_id, bm.chunk_id, bm.rank AS before, list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) AS cw FROM bm JOIN queries USING (query_id) JOIN ({CHUNKS}) c USING (chunk_id)), s AS (SELECT query_id, chunk_id, before, coalesce(len(list_intersect(qw, cw))::DOUBLE / nullif(len(qw), 0), 0) AS score FROM j), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, before)::INT AS rank, chunk_id, round(score, 6) AS score, before FROM s) SELECT * FROM r WHERE rank <= 5",
    "rerank_stored_scores": f"WITH c AS ({_ranked_sql('embedding')}), s AS (SELECT query_id, chunk_id, max(score) AS score FROM search_scores WHERE search_mode = 'rerank' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2), r AS (SELECT c.query_id, row_number() OVER (PARTITION BY c.query_id ORDER BY s.score DESC, c.rank)::INT AS rank, c.chunk_id, c.rank::INT AS before, round(s.score, 6) AS score FROM c JOIN s ON s.query_id = c.query_id AND s.chunk_id = c.chunk_id) SELECT * FROM r WHERE rank <= 5",
    "filtered_search": bm25_sql(3, " AND lang IN ('de', 'fr')") + "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM bm",
    "chunk_neighbors_range_join": f"SELECT DISTINCT h.query_id, n.source, n.chunk_index, n.chunk_id FROM (SELECT r.query_id, c.source, c.chunk_index FROM ({_ranked_sql('rerank', 3)}) r JOIN ({CHUNKS}) c USING (chunk_id)) h JOIN ({CHUNKS}) n ON n.source = h.source AND n.chunk_index BETWEEN greatest(0, h.chunk_index - 1) AND h.chunk_index + 1",
    "chunk_range_window": f"SELECT chunk_index, chunk_id, heading_title FROM ({CHUNKS}) WHERE source = '/srv/corpus/handbook/operations-journal.md' AND chunk_index BETWEEN 7 AND 11 AND EXISTS (SELECT 1 FROM chunks WHERE source = '/srv/corpus/handbook/operations-journal.md' AND chunk_index = 9)",
    "chunk_neighbors_window": f"SELECT chunk_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS following FROM ({CHUNKS}) WHERE chunk_index IS NOT NULL AND source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY chunk_index, chunk_id)",
    "rag_context": CONTEXT,
    "rag_excerpts": f"SELECT query_id, rank::INT AS rank, source, round(score, 6) AS score, substring(content, 1, 200) AS excerpt FROM ({RESULTS})",
    "rag_answer_passthrough": f"SELECT q.query_id, coalesce(c.context, 'No relevant documents found.') AS answer FROM queries q LEFT JOIN ({CONTEXT}) c USING (query_id)",
    "conversation_history": "SELECT conv_id, turn, len(h)::BIGINT AS n_history, array_to_string(h, ',') AS turns FROM (SELECT conv_id, turn, coalesce(list(turn) FILTER (WHERE turn % 4 <> 0) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM (SELECT coalesce(scenario, 'none') AS conv_id, query_id AS turn FROM queries))",
}
