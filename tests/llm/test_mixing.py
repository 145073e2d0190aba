import pytest
from conftest import clash

from chunkwise.llm import mixing as mx

D, T = "doc_id long, source string, text string", "source string, target_share double, max_repeats int"


def setup(spark):
    docs = [(i, "big", "one two three four five") for i in range(200)] + [(1000 + i, "small", "one two three four five") for i in range(20)] + [(2000 + i, "tiny", "a b c") for i in range(3)]
    docs += [(3000, None, "x " * 100), (3001, "big", None), (3002, "big", ""), (3003, "unlisted", "x y z")]
    targets = [("big", 0.5, 1), ("small", 0.2, 3), ("tiny", 0.2, 2), ("none", 0.1, 5), (None, 0.1, 1), ("zero", 0.0, 1)]
    return clash(spark.createDataFrame(docs, D), "tokens", "b", "h", "offset"), clash(spark.createDataFrame(targets, T), "tokens", "ramp", "short")


def test_short_sources(spark):
    docs, targets = setup(spark)
    assert sorted(r["source"] for r in mx.found(mx.sized(docs), targets).collect()) == ["none", "tiny"]
    assert mx.found(mx.sized(docs.where("false")), targets).count() == 0 and mx.found(mx.sized(docs), targets.where("false")).count() == 0


def test_mixture_meets_demand_within_one_document(spark):
    docs, targets = setup(spark)
    sized = mx.sized(docs)
    plan = {r["source"]: r for r in mx.plan(sized, targets).collect()}
    rows = mx.mixture(sized, targets).collect()
    for s in ("big", "small", "tiny"):
        mine = [r for r in rows if r["source"] == s]
        used = sum(r["tokens"] for r in mine)
        assert plan[s]["given"] <= used < plan[s]["given"] + 6 or used == plan[s]["most"]
        keys = [(r["doc_id"], r["copy"]) for r in mine]
        assert len(keys) == len(set(keys)) and max(r["copy"] for r in mine) <= plan[s]["max_repeats"]
        assert all(0 <= r["position"] <= 1 for r in mine)
    assert {r["source"] for r in rows} == {"big", "small", "tiny"}
    again = {(r["doc_id"], r["copy"], r["position"]) for r in mx.mixture(sized, targets).collect()}
    assert again == {(r["doc_id"], r["copy"], r["position"]) for r in rows}
    order = [r["position"] for r in mx.in_training_order(mx.mixture(sized, targets)).collect()]
    assert order == sorted(order)
    shares = {r["source"]: r for r in mx.shares(sized, targets).collect()}
    assert shares["none"]["mixed_tokens"] == 0 and shares["none"]["short"] and abs(shares["big"]["share_of_corpus_size"] - 0.5) < 0.01


@pytest.mark.parametrize("slopes", [{}, {"big": 0.9}, {"big": -0.7, "small": 3.0, "tiny": 0.4}])
def test_weights_of_every_tenth_of_training(spark, slopes):
    docs = spark.createDataFrame([(i, s, "one two three four five") for s, k in (("big", 3000), ("small", 900), ("tiny", 300)) for i in range(k)], D)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 4)], T)
    sized = mx.sized(docs)
    ramp = spark.createDataFrame([(k, v) for k, v in slopes.items()], "source string, ramp double")
    plan = {r["source"]: r for r in mx.schedules(mx.plan(sized, targets), ramp).collect()}
    assert abs(sum(r["given"] * r["ramp"] for r in plan.values())) < 1e-6 and all(abs(r["ramp"]) <= 1 for r in plan.values())
    rows = mx.mixture(sized, targets, ramp=ramp).collect()
    whole = sum(r["tokens"] for r in rows)
    for i in range(10):
        lo, hi = i / 10, (i + 1) / 10
        part = [r for r in rows if lo <= r["position"] < hi or (i == 9 and r["position"] == 1)]
        assert abs(sum(r["tokens"] for r in part) - whole / 10) < 0.005 * whole  # position is progress in tokens
        for s, p in plan.items():
            want = p["given"] * sum(1 + p["ramp"] * (2 * (lo + (k + 0.5) / 1000) - 1) for k in range(100)) / 1000
            assert abs(sum(r["tokens"] for r in part if r["source"] == s) - want) < 0.005 * whole, (s, i)


@pytest.mark.parametrize("ramp", [-0.8, 0.0, 0.6])
def test_schedule_inverse(spark, ramp):
    from pyspark.sql import functions as F

    df = spark.range(11).select((F.col("id") / 10).alias("t"), F.lit(ramp).alias("r"))
    back = df.select("t", mx.schedule_inverse(mx.schedule_cdf(F.col("t"), F.col("r")), F.col("r")).alias("u")).collect()
    assert all(abs(r["t"] - r["u"]) < 1e-9 for r in back)
