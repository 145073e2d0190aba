"""Retrieval quality: recall, mean reciprocal rank, hit rate, thresholds, and reading benchmark collections."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwise.functions.text import file_name, hit, safe_file_name

#: Roles of scenario documents.
ROLES = ("relevant", "distractor", "hard_negative")


def question_metrics(results: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """``(scenario, query_id, first_hit, hard_negative)`` for every question.

    ``results`` holds ``(query_id, rank, hit)``; ``first_hit`` is the smallest rank up to ``k`` of a hit, else null.
    Questions without results count too.
    """
    first = results.where(F.col("hit") & (F.col("rank") <= k)).groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    return questions.select("scenario", "query_id", "hard_negative").join(first, "query_id", "left").select("scenario", "query_id", "first_hit", "hard_negative")


def scenario_metrics(per_question: DataFrame) -> DataFrame:
    """``(scenario, questions, recall, mrr, hit_rate, hn_questions, hn_recall, hn_mrr)``; hard-negative figures are null
    where a scenario has no such question. Recall and hit rate are the same: one hit is enough."""
    hit = F.col("first_hit").isNotNull().cast("double")
    rr = F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))
    hard = F.col("hard_negative")
    return per_question.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(hit).alias("recall"), F.avg(rr).alias("mrr"), F.avg(hit).alias("hit_rate"),
        F.count_if(hard).alias("hn_questions"), F.avg(F.when(hard, hit)).alias("hn_recall"), F.avg(F.when(hard, rr)).alias("hn_mrr"),
    )


def overall(metrics: DataFrame) -> DataFrame:
    """Sum of questions, unweighted means over scenarios, and the hit rate weighted by questions."""
    return metrics.agg(
        F.sum("questions").alias("questions"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("hit_rate").alias("hit_rate"),
        (F.sum(F.col("hit_rate") * F.col("questions")) / F.sum("questions")).alias("weighted_hit_rate"),
    )


def verdict(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``(scenario, status)``: the first failing of recall, mrr, hit rate; PASS; empty where a scenario has no threshold."""
    j = metrics.join(thresholds, "scenario", "left")
    none = F.col("min_recall").isNull() & F.col("min_mrr").isNull() & F.col("min_hit_rate").isNull()
    out = F.when(none, "").when(F.col("recall") < F.col("min_recall"), "FAIL recall").when(F.col("mrr") < F.col("min_mrr"), "FAIL mrr").when(F.col("hit_rate") < F.col("min_hit_rate"), "FAIL hit_rate").otherwise("PASS")
    return j.select("scenario", out.alias("status"))


def any_failing(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.coalesce(F.bool_or(F.col("status").startswith("FAIL")), F.lit(False)).alias("any_failing"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order fixed by ``seed``, the same on every engine that has MD5."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_o", order).orderBy("_o", key).limit(n).drop("_o")


def beir_convert(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, n_questions: int = 50, n_distractors: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(documents(doc_id, role, file), questions(query_id, question, expected_sources))`` of a benchmark collection.

    Judgements below 1 are ignored; sampled are questions with a judged document of the corpus, and distractors among
    documents that are relevant to none of them.
    """
    good = qrels.where(F.col("score").try_cast("int") >= 1).select(F.col("query_id"), F.col("doc_id"))
    good = good.join(corpus.select("doc_id"), "doc_id", "left_semi")
    asked = seeded_sample(queries.join(good.select("query_id").distinct(), "query_id", "left_semi"), "query_id", n_questions, seed)
    want = good.join(asked.select("query_id"), "query_id", "left_semi")
    relevant = want.select("doc_id").distinct()
    others = seeded_sample(corpus.join(relevant, "doc_id", "left_anti"), "doc_id", n_distractors, seed)
    file = F.concat(safe_file_name(F.col("doc_id").cast("string")), F.lit(".txt"))
    docs = relevant.select("doc_id", F.lit("relevant").alias("role"), file.alias("file")).unionByName(others.select("doc_id", F.lit("distractor").alias("role"), file.alias("file")))
    questions = want.join(asked, "query_id").groupBy("query_id", "question").agg(F.array_sort(F.collect_set(file)).alias("expected_sources"))
    return docs, questions


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a benchmark folder (JSON lines and a tab-separated file with a header)."""
    corpus = spark.read.schema("_id STRING, title STRING, text STRING").json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc_id"), "title", "text")
    queries = spark.read.schema("_id STRING, text STRING").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("question"))
    raw = spark.read.option("sep", "\t").option("header", True).schema("`query-id` STRING, `corpus-id` STRING, score STRING").csv(f"{folder}/qrels/{split}.tsv")
    qrels = raw.select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id"), F.col("score").try_cast("int").alias("score")).where("score >= 1")
    return corpus, queries, qrels


def load_scenarios(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, questions, thresholds)`` of every ``questions.yaml`` below ``root``, by sorted folder.

    Unknown roles and documents that are not there are errors that name them.
    """
    import yaml

    docs, questions, limits = [], [], []
    for folder, _, files in sorted(os.walk(root)):
        if "questions.yaml" not in files:
            continue
        name = os.path.basename(folder)
        with open(os.path.join(folder, "questions.yaml"), encoding="utf-8") as f:
            y = yaml.safe_load(f) or {}
        for x in y.get("documents") or []:
            if x.get("role") not in ROLES:
                raise ValueError(f"{name}: unknown role {x.get('role')!r}")
            if not os.path.exists(os.path.join(folder, x["file"])):
                raise FileNotFoundError(f"{name}: {x['file']}")
            docs.append((name, x["file"], x["role"]))
        for q in y.get("questions") or []:
            questions.append((name, str(q["id"]), q["question"], list(q.get("expected_sources") or []), list(q.get("expected_chunk_contains") or [])))
        t = y.get("thresholds") or {}
        limits.append((name, t.get("recall_at_k"), t.get("mrr"), t.get("hit_rate_at_k")))
    return (
        spark.createDataFrame(docs, "scenario STRING, file STRING, role STRING"),
        spark.createDataFrame(questions, "scenario STRING, query_id STRING, question STRING, expected_sources ARRAY<STRING>, phrases ARRAY<STRING>"),
        spark.createDataFrame([(a, *(None if v is None else float(v) for v in b)) for a, *b in limits], "scenario STRING, min_recall DOUBLE, min_mrr DOUBLE, min_hit_rate DOUBLE"),
    )


def evaluate(spark: SparkSession, root: str, work: str, k: int = 3, mode: str = "hybrid", size: int = 1000, tokens: str = "bpe", embedder=None, rerank: bool = False) -> dict[str, DataFrame]:
    """Ingest the documents of every scenario below ``root``, ask its questions and measure what comes back.

    Each scenario has a store of its own below ``work``, so scenarios do not disturb one another; their number is that of
    the folders. A result is a hit if its text holds one of the phrases the question names or, where it names none, if its
    file is an expected source. Gives ``questions``, ``scenarios``, ``overall`` and ``verdict`` as tables.
    """
    from chunkwise.operators.store import Store

    documents, questions, limits = load_scenarios(spark, root)
    asked = with_hard_negatives(questions, documents).withColumn("query_id", F.concat_ws("/", "scenario", "query_id"))
    found = []
    for name, folder in scenario_folders(root):
        store = Store(spark, f"{work.rstrip('/')}/{name}")
        listed = documents.where(F.col("scenario") == name).select("file").collect()  # the files of one list
        store.ingest_paths([os.path.join(folder, r["file"]) for r in listed], size, tokens, embedder=embedder)
        found.append(store.search(asked.where(F.col("scenario") == name), k, mode, rerank=rerank, embedder=embedder).select("query_id", "rank", "source", "content"))
    results = found[0] if found else spark.createDataFrame([], "query_id string, rank int, source string, content string")
    for more in found[1:]:
        results = results.unionByName(more)
    judged = results.join(asked.select("query_id", "expected_sources", "phrases"), "query_id")
    judged = judged.select("query_id", "rank", hit(file_name("source"), "content", "expected_sources", "phrases").alias("hit"))
    per = question_metrics(judged, asked, k)
    metrics = scenario_metrics(per)
    return {"questions": per, "scenarios": metrics, "overall": overall(metrics), "verdict": verdict(metrics, limits)}


def scenario_folders(root: str) -> list[tuple[str, str]]:
    return [(os.path.basename(folder), folder) for folder, _, files in sorted(os.walk(root)) if "questions.yaml" in files]


#: Public benchmark collections by the names they are published under, with documents and questions (about).
BEIR = (
    ("nfcorpus", 3633, 323), ("scifact", 5183, 300), ("fiqa", 57638, 648), ("arguana", 8674, 1406), ("trec-covid", 171332, 50), ("webis-touche2020", 382545, 49),
    ("dbpedia-entity", 4635922, 400), ("scidocs", 25657, 1000), ("fever", 5416568, 6666), ("hotpotqa", 5233329, 7405),
)


def beir_registry(spark: SparkSession) -> DataFrame:
    """``(name, documents, questions)`` of the collections that can be converted."""
    return spark.createDataFrame(BEIR, "name string, documents bigint, questions bigint")


def write_scenario(corpus: DataFrame, docs: DataFrame, questions: DataFrame, folder: str) -> None:
    """Write a converted benchmark as a scenario: a text file per sampled document and ``questions.yaml``.

    Takes what :func:`beir_convert` gives, which is bounded by its numbers of questions and distractors and the judged
    documents of those questions. Titles stand above their texts."""
    import yaml

    os.makedirs(folder, exist_ok=True)
    listed = []
    for r in docs.join(corpus, "doc_id").orderBy("role", "file").collect():
        with open(os.path.join(folder, r["file"]), "w", encoding="utf-8") as f:
            f.write("\n\n".join(x for x in (r["title"], r["text"]) if x))
        listed.append({"file": r["file"], "role": r["role"]})
    asked = [{"id": r["query_id"], "question": r["question"], "expected_sources": list(r["expected_sources"])} for r in questions.orderBy("query_id").collect()]
    with open(os.path.join(folder, "questions.yaml"), "w", encoding="utf-8") as f:
        yaml.safe_dump({"documents": listed, "questions": asked}, f, allow_unicode=True, sort_keys=False)


def with_hard_negatives(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """``questions`` with ``hard_negative``: one of the expected sources stands for a hard negative of the scenario."""
    hard = documents.where("role = 'hard_negative'").groupBy("scenario").agg(F.collect_set("file").alias("_hard"))
    return questions.join(hard, "scenario", "left").withColumn("hard_negative", F.coalesce(F.arrays_overlap("expected_sources", "_hard"), F.lit(False))).drop("_hard")


def ranked(results: DataFrame, score: str = "score", key: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return results.withColumn("rank", F.row_number().over(w))
