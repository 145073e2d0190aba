import random

from conftest import clash

from chunkwise.llm import borda

S = "query_id long, chunk_id string, search_mode string, score double"


def brute(rows):
    best = {}
    for q, c, m, s in rows:
        if q is None or c is None or m not in borda.MODES:
            continue
        s = None if s is None or s != s else s
        k = (q, c, m)
        best[k] = s if best.get(k) is None else best[k] if s is None else max(best[k], s)
    out = {}
    for q in {k[0] for k in best}:
        items = sorted({k[1] for k in best if k[0] == q})
        n = len(items)
        for c in items:
            total = 0.0
            for m in borda.MODES:
                have = [best.get((q, x, m)) for x in items]
                present = [s for s in have if s is not None]
                mine = best.get((q, c, m))
                rank = (len(present) + 1 + n) / 2 if mine is None else sum(s > mine for s in present) + (sum(s == mine for s in present) + 1) / 2
                total += n - rank
            out[q, c] = 2 * total
    return out


def points(spark, rows, **kw):
    df = clash(spark.createDataFrame(rows, S), "n", "b", "rank2", "cuts", "m_0")
    return {(r["query_id"], r["chunk_id"]): float(r["points2"]) for r in borda.borda(df, **kw).collect()}


def test_against_brute_force_with_dirt(spark):
    rnd = random.Random(4)
    rows = [(q, f"c{rnd.randint(0, 30)}", rnd.choice(borda.MODES), rnd.choice([rnd.random(), 0.5, None, float("nan"), -3.0])) for q in (1, 2, 3) for _ in range(120)]
    rows += rows[:20] + [(None, "c", "bm25", 1.0), (1, None, "bm25", 1.0), (1, "c1", "odd", 9.0), (9, "only", "bm25", None)]
    assert points(spark, rows) == brute(rows)
    assert points(spark, rows, buckets=4) == brute(rows)


def test_range_of_a_score_means_nothing(spark):
    rows = [(1, c, m, s) for m, k in (("bm25", 1e9), ("embedding", 1e-9), ("rerank", 1.0)) for c, s in (("a", 3.0 * k), ("b", 2.0 * k), ("c", 1.0 * k))]
    got = borda.top(spark.createDataFrame(rows, S), 2).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ["a", "b"]


def test_all_tied_goes_by_id_and_empty_is_empty(spark):
    rows = [(1, c, "bm25", 1.0) for c in "dcba"]
    assert [r["chunk_id"] for r in borda.top(spark.createDataFrame(rows, S), 3).orderBy("place").collect()] == ["a", "b", "c"]
    assert points(spark, []) == {}
