import math
import random

from chunkwise.functions import tokens
from chunkwise.operators import search

CH = "chunk_id string, source string, chunk_index int, content string, vector array<float>"


def make(spark, texts):
    return spark.createDataFrame([(f"c{i}", "s", i, t, None) for i, t in enumerate(texts)], CH)


def ranks(spark, rows):
    return spark.createDataFrame([(1, k, r) for k, r in rows], "query_id long, chunk_id string, rank int")


def test_bm25_against_brute_force(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("red green blue tall small".split()) for _ in range(rnd.randint(1, 12))) for _ in range(30)] + [None, "", "  "]
    q = spark.createDataFrame([(1, "red, tall tall"), (2, "absent"), (3, None), (4, "")], "query_id long, question string")
    got = {r["chunk_id"]: r["raw"] for r in search.bm25(make(spark, texts), q, 40).collect() if r["query_id"] == 1}
    docs = {f"c{i}": t.split() for i, t in enumerate(texts) if t and t.strip()}
    avg = sum(map(len, docs.values())) / len(docs)
    want = {}
    for w in ("red", "tall", "tall"):
        df = sum(w in d for d in docs.values())
        for k, d in docs.items():
            if w in d:
                tf = d.count(w)
                want[k] = want.get(k, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_score_is_one_and_ties_go_by_id(spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, question string")
    got = search.bm25(make(spark, ["a", "a", "b"]), q, 1).collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("c0", 1.0)]


def test_fusion_rules(spark):
    both = search.fuse(ranks(spark, [("a", 1), ("b", 2)]), ranks(spark, [("a", 1), ("c", 2)]))
    rows = {r["chunk_id"]: r for r in both.collect()}
    assert rows["a"]["score"] == 1.0 and rows["a"]["rank"] == 1
    assert abs(rows["b"]["score"] - (1 / 62 + 1 / 64) / (2 / 61)) < 1e-12 and rows["b"]["rank"] == 2 and rows["c"]["rank"] == 3
    one = search.fuse(ranks(spark, [("a", 1)]), ranks(spark, []))
    assert abs(one.collect()[0]["score"] - (1 / 61 + 1 / 62) / (2 / 61)) < 1e-12


def test_knn_leaves_unusable_vectors_out(spark):
    v = lambda *x: [float(a) for a in x]
    c = spark.createDataFrame([("a", v(1, 0)), ("b", v(0, 1)), ("c", v(0, 0)), ("d", v(1)), ("e", None), ("f", v(float("nan"), 1)), ("a", v(1, 0))], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([(1, v(1, 0)), (2, None), (3, v(0, 0))], "query_id long, qvec array<float>")
    got = search.knn(c, q, 5, dim=2).collect()
    assert [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in got] == [(1, 1, "a", 1.0), (1, 2, "b", 0.5)]
    assert search.knn(c, q.where("false"), 5, dim=2).count() == 0


def test_context_range_and_neighbours(spark):
    c = make(spark, ["a", "b", "c", None])
    assert [r["chunk_index"] for r in search.chunk_range(c, "s", 0, 1).collect()] == [0, 1]
    assert search.chunk_range(c, "s", 9, 5).count() == 0
    hits = spark.createDataFrame([(1, "s", 1), (1, "s", 2)], "query_id long, source string, chunk_index int")
    assert sorted(r["chunk_index"] for r in search.neighbours_of(hits, c, 1).collect()) == [0, 1, 2, 3]
    res = spark.createDataFrame([(1, 2, "y", "two"), (1, 1, "x", "one")], "query_id long, rank int, source string, content string")
    assert search.prompt_context(res).first()["context"] == '<document source="x">\none\n</document>\n\n<document source="y">\ntwo\n</document>'
    q = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, question string")
    said = {r["query_id"]: r["answer"] for r in search.answer(res, q, lambda a, b: a + "!").collect()}
    assert said == {1: "q!", 2: "No relevant documents found."}


def test_history_holds_answered_turns_only(spark):
    t = spark.createDataFrame([("a", 1, "q1", "x"), ("a", 2, "q2", None), ("a", 3, "q3", "z")], "conv_id string, turn int, question string, answer string")
    got = {r["turn"]: [h["turn"] for h in r["history"]] for r in search.conversation_history(t).collect()}
    assert got == {1: [], 2: [1], 3: [1]}


def test_porter_stems():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "agreed": "agre", "happy": "happi", "generalizations": "gener", "sky": "sky", "motoring": "motor", "failing": "fail", "filing": "file"}
    assert {w: tokens.porter(w) for w in words} == words


def test_stems_keep_null_and_empty_lists(spark):
    t = spark.createDataFrame([(1, ["ponies", "sky"]), (2, None), (3, []), (4, ["motoring"])], "i int, w array<string>")
    got = {r["i"]: r["s"] for r in t.select("i", tokens.stems("w").alias("s")).collect()}
    assert got == {1: ["poni", "sky"], 2: None, 3: [], 4: ["motor"]}
