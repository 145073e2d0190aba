import pytest
from pyspark.sql import functions as F

from chunkwise.commits import CommitLog, Conflict
from chunkwise.operators import evaluation as ev
from chunkwise.operators import search
from chunkwise.operators.chunking import word_windows
from chunkwise.operators.store import Conversation, Store, embed
from chunkwise.streaming import ingest

SRC = "source string, mtime long, text string, status_code int"


def chunk(df):
    return word_windows(df, "source", "text", 3).select("source", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("chunk").alias("content"))


def src(spark, *rows):
    return spark.createDataFrame([(*r, None)[:4] if len(r) == 3 else r for r in rows], SRC)


def test_life_of_a_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), dim=64)
    assert not s.exists() and s.chunks().count() == 0
    got = s.ingest(src(spark, ("/a.txt", 1, "a b c d"), ("https://u", 1, "x y"), ("/e.txt", 1, ""), ("https://bad", 1, "z", 404)), chunk, 1000)
    assert got == {"ingested": 2, "chunks": 3, "skipped": 0, "failed": 1, "empty": 1}
    assert s.ingest(src(spark, ("/a.txt", 1, "a b c d"), ("https://u", 2, "x y")), chunk, 2000)["skipped"] == 2
    assert s.ingest(src(spark, ("/a.txt", 2, "new text")), chunk, 2000)["chunks"] == 1
    assert [r["content"] for r in s.show("/a.txt").collect()] == ["new text"]
    probe = spark.createDataFrame([("/a.txt", 2)], "source string, current_mtime long")
    assert {r["source"]: r["status"] for r in s.list(probe, 1500, 1000).collect()} == {"/a.txt": "CURRENT", "https://u": "CURRENT"}
    assert s.status(probe, 9_000_000_000).first().asDict() == {"documents": 2, "chunks": 2, "last_mtime": 2, "stale": 1, "bytes": 11}
    re = s.reingest(src(spark, ("/a.txt", 2, "new text"), ("https://u", 1, "x y")), chunk, 9_000_000_000)
    assert re == {"stale": 1, "reingested": 0, "chunks": 0, "touched": 1, "skipped": 0}
    row = s.show("https://u").first()
    assert row["ingest_time"] == 9_000_000_000 and row["content_hash"] and len(row["vector"]) == 64
    assert s.delete(["/a.txt", "/none"]) == {"/a.txt": 1, "/none": 0}
    s.drop_all()
    assert s.chunks().count() == 0
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), dim=32)


def test_append_keeps_old_chunks(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("i", "/a", 0, "x")], "chunk_id string, source string, chunk_index int, content string")
    s.upsert(rows)
    s.upsert(rows, append=True)
    assert s.chunks().count() == 2


def written(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


C = "chunk_id string, source string, chunk_index int, content string"


def test_changes_write_about_as_much_as_they_change(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert(spark.createDataFrame([(f"{i}#0", f"/{i}", 0, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(600)], C))
    before = written(tmp_path / "s")
    s.upsert(spark.createDataFrame([("7#0", "/7", 0, "new words")], C))
    s.delete(["/8"])
    s.touch(spark.createDataFrame([("/9",)], "source string"), 5)
    assert written(tmp_path / "s") - before < before / 4
    got = {r["source"]: (r["content"], r["ingest_time"]) for r in s.chunks().collect()}
    assert len(got) == 599 and got["/7"] == ("new words", None) and got["/9"][1] == 5 and "/8" not in got
    assert {r["source"]: r["ingest_time"] for r in s.state().where("source IN ('/7', '/9')").collect()} == {"/7": None, "/9": 5}
    m = s.manifest()
    s.compact()
    assert {r["source"]: (r["content"], r["ingest_time"]) for r in s.chunks().collect()} == got
    assert len(m["segments"]) == 2 and len(s.manifest()["segments"]) == 1 and not s.manifest()["dead"] and s.vacuum() and s.chunks().count() == 599


def test_two_writers_and_a_dead_one(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.upsert(spark.createDataFrame([("1", "/a", 0, "x")], C))
    left = b._segment(spark.createDataFrame([("9", "/z", 0, "lost")], C))  # a writer that dies before its commit
    folder = b._segment(spark.createDataFrame([("2", "/b", 0, "y")], C))
    a.upsert(spark.createDataFrame([("3", "/a", 0, "z")], C))
    b._commit(segments=folder)
    assert sorted(r["content"] for r in a.chunks().collect()) == ["y", "z"] and left in a.vacuum()
    with pytest.raises(Conflict):
        a.log.commit(a.log.head(), {})
    slow = CommitLog(spark, str(tmp_path / "other"))
    with pytest.raises(TimeoutError):
        slow.change(lambda n, e: slow.commit(n, {}) or {}, retry_ms=1, timeout_s=0.05)


def test_search_chunk_and_conversation(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = [(f"/{i}#{j}", f"/{i}", j, f"alpha {'beta' if i == 2 else 'gamma'} text {i} {j}") for i in range(4) for j in range(3)]
    s.upsert(embed(spark.createDataFrame(rows[:6], C), "content"))
    s.upsert(embed(spark.createDataFrame(rows[6:], C), "content"))
    s.upsert(embed(spark.createDataFrame([("/2#0", "/2", 0, "beta beta only")], C), "content"))
    q = spark.createDataFrame([(1, "beta"), (2, "alpha gamma"), (3, " "), (4, None), (5, "unknownword")], "query_id long, question string")
    got = s.search(q, 3, "bm25").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got if r["query_id"] == 1] == [(1, "/2#0")] and {r["query_id"] for r in got} == {1, 2}
    want = {(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in search.bm25(s.chunks(), q.where("query_id < 3"), 3).collect()}
    assert {(r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in got} == want
    for mode in ("embedding", "hybrid"):
        assert s.search(q, 2, mode, rerank=True).where("query_id = 1 AND rank = 1").first()["chunk_id"] == "/2#0"
    with pytest.raises(ValueError):
        s.search(q, 2, "odd")
    assert [r["chunk_index"] for r in s.chunk("/1", 1, 1).collect()] == [0, 1, 2]
    with pytest.raises(LookupError):
        s.chunk("/1", 9)
    talk = Conversation(s, lambda question, context, history: f"{len(history)} {'beta' in context}", mode="bm25")
    assert [talk.ask("beta"), talk.ask("beta")] == ["0 True", "1 True"]
    talk.reset()
    assert talk.ask("unknownword") == "0 False"
    with pytest.raises(ValueError):
        talk.ask(" ")


def test_ingest_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Head\n\nsome text")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.4 binary")

    def fetcher(url):
        return (b"<h1>Page</h1><p>from the net</p>", "text/html", None, 200) if "good" in url else (b"", "", None, 599)

    s = Store(spark, str(tmp_path / "s"))
    got = s.ingest_paths([str(tmp_path / "in"), "https://good", "https://bad", "/no/such"], now_ms=7, fetcher=fetcher)
    assert got == {"ingested": 2, "chunks": 2, "skipped": 0, "failed": 1, "empty": 1, "missing": ["/no/such"]}
    assert {r["source"].rsplit("/", 1)[-1]: r["heading_path"] for r in s.chunks().collect()} == {"a.md": ["Head"], "good": ["Page"]}
    assert s.ingest_paths([str(tmp_path / "in")])["skipped"] == 1


def test_streaming_ingest(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    feed = str(tmp_path / "feed")
    src(spark, ("/a", 1, "old"), ("/a", 2, "newer words"), ("/b", 1, "b")).drop("status_code").write.parquet(feed)
    stream = spark.readStream.schema("source string, mtime long, text string").parquet(feed)
    for _ in range(2):
        q = ingest.watch(stream, s, chunk, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert sorted(r["content"] for r in s.chunks().collect()) == ["b", "newer words"]


def test_metrics(spark):
    q = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("t", 3, False)], "scenario string, query_id long, hard_negative boolean")
    r = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 4, True)], "query_id long, rank int, hit boolean")
    m = ev.scenario_metrics(ev.question_metrics(r, q, 3))
    rows = {x["scenario"]: x for x in m.collect()}
    assert rows["s"]["recall"] == 0.5 and rows["s"]["mrr"] == 0.25 and rows["s"]["hn_recall"] == 0.0 and rows["t"]["hn_recall"] is None
    o = ev.overall(m).first()
    assert o["questions"] == 3 and o["recall"] == 0.25 and abs(o["weighted_hit_rate"] - 1 / 3) < 1e-12
    limits = spark.createDataFrame([("s", 0.5, 0.3, None)], "scenario string, min_recall double, min_mrr double, min_hit_rate double")
    v = ev.verdict(m, limits)
    assert {x["scenario"]: x["status"] for x in v.collect()} == {"s": "FAIL mrr", "t": ""} and ev.any_failing(v).first()[0]


def test_evaluate_end_to_end(spark, tmp_path):
    texts = {
        "rivers.md": "# Rivers\n\n## Source\n\nA river begins at a spring in the mountains.\n\n## Mouth\n\nIts mouth forms a delta by the sea.",
        "bread.txt": "Bread dough rises because yeast makes gas. Bake the loaf in a hot oven.",
        "noise.txt": "The parade passed the town hall at noon.",
    }
    for name, asked in (("one", [("where does a river begin", "rivers.md", ["spring"]), ("why does dough rise", "bread.txt", None)]), ("two", [("what forms a delta", "rivers.md", None), ("zebra quagga", "bread.txt", None)])):
        (tmp_path / "in" / name).mkdir(parents=True)
        for file, text in texts.items():
            (tmp_path / "in" / name / file).write_text(text)
        lines = ["documents:", "- {file: rivers.md, role: relevant}", "- {file: bread.txt, role: hard_negative}", "- {file: noise.txt, role: distractor}", "questions:"]
        for i, (q, source, phrases) in enumerate(asked):
            lines += [f"- id: {i}", f"  question: {q}", f"  expected_sources: [{source}]"] + ([f"  expected_chunk_contains: {phrases}"] if phrases else [])
        (tmp_path / "in" / name / "questions.yaml").write_text("\n".join([*lines, "thresholds: {recall_at_k: 0.8}"]))
    got = ev.evaluate(spark, str(tmp_path / "in"), str(tmp_path / "work"), 3, "bm25", 60, "words")
    rows = {r["scenario"]: r for r in got["scenarios"].collect()}
    assert rows["one"]["recall"] == rows["one"]["mrr"] == 1.0 and rows["two"]["recall"] == 0.5 and rows["one"]["hn_recall"] == 1.0
    assert {r["scenario"]: r["status"] for r in got["verdict"].collect()} == {"one": "PASS", "two": "FAIL recall"} and got["overall"].first()["questions"] == 4


def test_scenarios_and_beir(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    (d / "a.md").write_text("x")
    (d / "questions.yaml").write_text("documents: [{file: a.md, role: hard_negative}]\nquestions: [{id: 1, question: q, expected_sources: [a.md]}]\nthresholds: {mrr: 0.5}\n")
    docs, questions, limits = ev.load_scenarios(spark, str(tmp_path))
    assert ev.with_hard_negatives(questions, docs).first()["hard_negative"] and limits.first()["min_mrr"] == 0.5
    (d / "questions.yaml").write_text("documents: [{file: a.md, role: odd}]")
    with pytest.raises(ValueError):
        ev.load_scenarios(spark, str(tmp_path))
    b = tmp_path / "beir"
    (b / "qrels").mkdir(parents=True)
    (b / "corpus.jsonl").write_text('{"_id":"d/1","title":"t","text":"x"}\n{"_id":"d2","title":"","text":"y"}\n')
    (b / "queries.jsonl").write_text('{"_id":"q","text":"why"}\n')
    (b / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\td/1\t1\nq\td2\t0\n")
    corpus, queries, qrels = ev.read_beir(spark, str(b))
    docs, questions = ev.beir_convert(corpus, queries, qrels)
    assert {(r["doc_id"], r["role"], r["file"]) for r in docs.collect()} == {("d/1", "relevant", "d_1.txt"), ("d2", "distractor", "d2.txt")}
    assert questions.first()["expected_sources"] == ["d_1.txt"]
    ev.write_scenario(corpus, docs, questions, str(tmp_path / "out" / "beir"))
    again, asked, _ = ev.load_scenarios(spark, str(tmp_path / "out"))
    assert again.count() == 2 and asked.first()["question"] == "why" and (tmp_path / "out" / "beir" / "d_1.txt").read_text() == "t\n\nx"
    assert ev.beir_registry(spark).count() == 10
