"""Queries over retrieval quality. The stored reranker order is the reference judgement, other lists are measured by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkwise.functions import text as tx
from chunkwise.operators import evaluation as ev
from chunkwise.operators.search import live_chunks
from chunkwise.plans.search import CHUNKS, _ranked, _ranked_sql
from chunkwise.session import table


def _questions(spark, d):
    """Questions with the scenario, expected file names (of the two best reranked chunks) and hard-negative flag."""
    c = live_chunks(table(spark, d, "chunks")).select("chunk_id", "source")
    best = _ranked(spark, d, "rerank", 2).join(c, "chunk_id").groupBy("query_id").agg(F.collect_set(tx.file_name("source")).alias("expected"))
    q = table(spark, d, "queries").select("query_id", F.coalesce("scenario", F.lit("none")).alias("scenario"))
    return q.join(best, "query_id", "left").withColumn("hard_negative", F.col("query_id") % 5 == 0)


def _hits(spark, d):
    c = live_chunks(table(spark, d, "chunks")).select("chunk_id", "source", "content")
    r = _ranked(spark, d, "embedding", 5).select("query_id", "rank", "chunk_id").join(c, "chunk_id")
    j = r.join(_questions(spark, d).select("query_id", "expected"), "query_id")
    return j.select("query_id", "rank", tx.hit(tx.file_name("source"), "content", "expected", F.array().cast("array<string>")).alias("hit"))


def _metrics(spark, d):
    return ev.scenario_metrics(ev.question_metrics(_hits(spark, d), _questions(spark, d), 3))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def eval_hits(spark, d):
    return _hits(spark, d)


def eval_recall_mrr(spark, d):
    return _rounded(_metrics(spark, d), "recall", "mrr", "hit_rate").select("scenario", "questions", "recall", "mrr", "hit_rate")


def eval_hard_negative(spark, d):
    return _rounded(_metrics(spark, d), "hn_recall", "hn_mrr").select("scenario", "hn_questions", "hn_recall", "hn_mrr")


def eval_overall(spark, d):
    return _rounded(ev.overall(_metrics(spark, d)), "recall", "mrr", "hit_rate", "weighted_hit_rate")


def _verdicts(spark, d):
    limits = spark.createDataFrame([("single-fact", 0.2, 0.1, None), ("none", 0.99, None, None)], "scenario STRING, min_recall DOUBLE, min_mrr DOUBLE, min_hit_rate DOUBLE")
    return ev.verdict(_metrics(spark, d), limits)


def eval_threshold_status(spark, d):
    return _verdicts(spark, d)


def eval_any_failing(spark, d):
    return ev.any_failing(_verdicts(spark, d))


def expected_contains_hit(spark, d):
    """Does a retrieved chunk hold the last word of its question? Phrases come before file names."""
    c = live_chunks(table(spark, d, "chunks")).select("chunk_id", "source", "content")
    q = table(spark, d, "queries").where("question IS NOT NULL").select("query_id", F.array(F.element_at(F.split(F.regexp_replace("question", r"[^\w]+$", ""), " "), -1)).alias("phrases"))
    r = _ranked(spark, d, "bm25", 5).select("query_id", "rank", "chunk_id").join(c, "chunk_id").join(q, "query_id")
    return r.select("query_id", "rank", tx.hit(tx.file_name("source"), "content", F.array().cast("array<string>"), "phrases").alias("hit"))


def beir_qrels_filter(spark, d):
    """Judgements as text, of which only whole numbers of 1 and more stay."""
    s = table(spark, d, "search_scores").where("search_mode = 'rerank'").select("query_id", "chunk_id", F.floor("score").cast("string").alias("score")).distinct()
    return s.where(F.col("score").try_cast("int") >= 1).select("query_id", "chunk_id", F.col("score").try_cast("int").alias("score"))


def _beir(spark, d):
    corpus = live_chunks(table(spark, d, "chunks")).select(F.col("chunk_id").alias("doc_id"))
    qrels = beir_qrels_filter(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("score").cast("string").alias("score"))
    return ev.beir_convert(corpus, table(spark, d, "queries").select("query_id", "question"), qrels, 10, 20)


def beir_documents(spark, d):
    return _beir(spark, d)[0]


def beir_questions(spark, d):
    return _beir(spark, d)[1].select("query_id", F.array_join("expected_sources", ",").alias("expected"))


def beir_sample_questions(spark, d):
    return ev.seeded_sample(table(spark, d, "queries").select("query_id"), "query_id", 10)


def filename_sanitize(spark, d):
    return table(spark, d, "chunks").where("source IS NOT NULL").select("source").distinct().select("source", tx.safe_file_name("source").alias("file"))


NAMES = (eval_hits, eval_recall_mrr, eval_hard_negative, eval_overall, eval_threshold_status, eval_any_failing, expected_contains_hit, beir_qrels_filter, beir_documents, beir_questions, beir_sample_questions, filename_sanitize)
QUERIES = {f.__name__: f for f in NAMES}

BASE = (
    f"best AS (SELECT query_id, list(DISTINCT string_split(source, '/')[-1]) AS expected FROM ({_ranked_sql('rerank', 2)}) JOIN ({CHUNKS}) USING (chunk_id) GROUP BY 1), "
    "qs AS (SELECT q.query_id, coalesce(scenario, 'none') AS scenario, expected, q.query_id % 5 = 0 AS hn FROM queries q LEFT JOIN best USING (query_id)), "
    f"hits AS (SELECT r.query_id, r.rank::INT AS rank, coalesce(list_contains(qs.expected, string_split(c.source, '/')[-1]), false) AS hit FROM ({_ranked_sql('embedding', 5)}) r JOIN ({CHUNKS}) c USING (chunk_id) JOIN qs USING (query_id)), "
    "fh AS (SELECT query_id, min(rank) AS fh FROM hits WHERE hit AND rank <= 3 GROUP BY 1), pq AS (SELECT scenario, qs.query_id, fh, hn FROM qs LEFT JOIN fh USING (query_id)), "
    "m AS (SELECT scenario, count(*) AS questions, avg((fh IS NOT NULL)::INT::DOUBLE) AS recall, avg(coalesce(1::DOUBLE / fh, 0)) AS mrr, count(*) FILTER (WHERE hn) AS hn_questions, avg((fh IS NOT NULL)::INT::DOUBLE) FILTER (WHERE hn) AS hn_recall, avg(coalesce(1::DOUBLE / fh, 0)) FILTER (WHERE hn) AS hn_mrr FROM pq GROUP BY 1) "
)
VERDICT = "v AS (SELECT m.scenario, CASE WHEN t.scenario IS NULL THEN '' WHEN recall < min_recall THEN 'FAIL recall' WHEN mrr < min_mrr THEN 'FAIL mrr' ELSE 'PASS' END AS status FROM m LEFT JOIN (VALUES ('single-fact', 0.2::DOUBLE, 0.1::DOUBLE), ('none', 0.99::DOUBLE, NULL)) t(scenario, min_recall, min_mrr) USING (scenario)) "
QRELS = "SELECT DISTINCT query_id, chunk_id, floor(score)::INT AS score FROM search_scores WHERE search_mode = 'rerank' AND score IS NOT NULL AND NOT isnan(score) AND floor(score) >= 1"
BEIR = (
    f"WITH good AS (SELECT query_id, chunk_id AS doc_id FROM ({QRELS}) WHERE chunk_id IN (SELECT chunk_id FROM chunks)), "
    "asked AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM good) ORDER BY md5('42:' || query_id), query_id LIMIT 10), "
    "want AS (SELECT * FROM good WHERE query_id IN (SELECT query_id FROM asked)), rel AS (SELECT DISTINCT doc_id FROM want), "
    f"oth AS (SELECT chunk_id AS doc_id FROM ({CHUNKS}) WHERE chunk_id NOT IN (SELECT doc_id FROM rel) ORDER BY md5('42:' || chunk_id), chunk_id LIMIT 20) "
)
FILE = "left(regexp_replace(doc_id, '[^a-zA-Z0-9]', '_', 'g'), 120) || '.txt'"
SQL = {
    "eval_hits": f"WITH {BASE} SELECT * FROM hits",
    "eval_recall_mrr": f"WITH {BASE} SELECT scenario, questions, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(recall, 6) AS hit_rate FROM m",
    "eval_hard_negative": f"WITH {BASE} SELECT scenario, hn_questions, round(hn_recall, 6) AS hn_recall, round(hn_mrr, 6) AS hn_mrr FROM m",
    "eval_overall": f"WITH {BASE} SELECT sum(questions)::BIGINT AS questions, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS hit_rate, round(sum(recall * questions) / sum(questions), 6) AS weighted_hit_rate FROM m",
    "eval_threshold_status": f"WITH {BASE}, {VERDICT} SELECT * FROM v",
    "eval_any_failing": f"WITH {BASE}, {VERDICT} SELECT coalesce(bool_or(starts_with(status, 'FAIL')), false) AS any_failing FROM v",
    "expected_contains_hit": f"SELECT r.query_id, r.rank::INT AS rank, coalesce(contains(lower(c.content), lower(string_split(regexp_replace(q.question, '[^\\w]+$', ''), ' ')[-1])), false) AS hit FROM ({_ranked_sql('bm25', 5)}) r JOIN ({CHUNKS}) c USING (chunk_id) JOIN (SELECT * FROM queries WHERE question IS NOT NULL) q USING (query_id)",
    "beir_qrels_filter": QRELS,
    "beir_documents": BEIR + f"SELECT doc_id, 'relevant' AS role, {FILE} AS file FROM rel UNION ALL SELECT doc_id, 'distractor', {FILE} FROM oth",
    "beir_questions": BEIR + f"SELECT query_id, string_agg(DISTINCT {FILE}, ',' ORDER BY {FILE}) AS expected FROM want GROUP BY 1",
    "beir_sample_questions": "SELECT query_id FROM queries ORDER BY md5('42:' || query_id), query_id LIMIT 10",
    "filename_sanitize": "SELECT source, left(regexp_replace(source, '[^a-zA-Z0-9]', '_', 'g'), 120) AS file FROM (SELECT DISTINCT source FROM chunks WHERE source IS NOT NULL)",
}
