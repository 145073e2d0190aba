import numpy as np
from conftest import clash

from chunkwise.llm import neighbours as nb

S = "chunk_id string, vector array<float>"


def families(n, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    x = np.repeat(base, 4, 0) + 0.45 * rng.standard_normal((4 * n, dim))
    return [(f"v{i:05d}", [float(a) for a in v * (1 + i % 3)]) for i, v in enumerate(x)]


def brute(rows, k=3):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {rows[i][0]: {rows[j][0] for j in np.argsort(-s[i])[:k]} for i in range(len(rows))}


def near(spark, rows, p=nb.Params()):
    df = clash(spark.createDataFrame(rows, S), "cell", "vid", "vec", "n", "id", "sim", "place")
    out = {}
    for r in nb.nearest(df, p).collect():
        out.setdefault(r["id"], []).append((r["place"], r["neighbour"]))
    return {k: [n for _, n in sorted(v)] for k, v in out.items()}


def test_recall_with_many_cells(spark):
    rows = families(600)
    got, want = near(spark, rows, nb.Params(cell=150, probes=4)), brute(rows)
    recall = sum(len(set(got[k]) & want[k]) for k in want) / sum(map(len, want.values()))
    assert recall >= 0.9 and all(len(v) == 3 for v in got.values())


def test_depth_follows_the_rows():
    assert nb.fans(1000, nb.Params()) == [1] and nb.fans(200_000, nb.Params()) == [128]
    assert nb.fans(33_000_000, nb.Params()) == [128, 128]
    for n in (10**3, 10**6, 10**9, 10**11):
        cells = int(np.prod(nb.fans(n, nb.Params()), dtype=object))
        assert max(nb.fans(n, nb.Params())) <= 256 and (n < 3000 or n / cells < 3000)


def test_recall_over_two_and_three_levels(spark):
    rows = families(700)
    want = brute(rows)
    for fan in (16, 4):
        p = nb.Params(cell=80, fan=fan, probes=6)
        assert len(nb.fans(len(rows), p)) == (2 if fan == 16 else 3)
        got = near(spark, rows, p)
        recall = sum(len(set(got[k]) & want[k]) for k in want) / sum(map(len, want.values()))
        assert recall >= 0.9 and all(len(v) == 3 for v in got.values()), (fan, recall)


def test_one_cell_is_exact_and_units_change_nothing(spark):
    rows = families(30)
    want = brute(rows)
    assert {k: set(v) for k, v in near(spark, rows).items()} == want
    assert {k: set(v) for k, v in near(spark, rows, nb.Params(block=16, queries=32)).items()} == want


def test_copies_ties_and_dirt(spark):
    a, b = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    rows = [(f"a{i}", a) for i in range(6)] + [("a0", a), ("b0", [x * 5 for x in b]), ("z", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0]), ("null", None), (None, a), ("hole", [None] + [1.0] * 63)]
    got = near(spark, rows)
    assert got["a0"] == ["a1", "a2", "a3"] and got["a5"] == ["a0", "a1", "a2"] and got["b0"] == ["a0", "a1", "a2"] and set(got) == {f"a{i}" for i in range(6)} | {"b0"}
    found = {(r[0], r[1]) for r in nb.pairs(spark.createDataFrame(rows, S)).collect()}
    assert ("a0", "b0") in found and all(x < y for x, y in found)


def test_empty_and_single(spark):
    assert near(spark, []) == {} and near(spark, families(1)[:1]) == {}


def test_partition_is_balanced():
    x = np.array([v for _, v in families(500)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = nb.balanced_partition(nb.neighbour_graph(x, 6), 16, np.random.default_rng(0))
    sizes = np.bincount(label, minlength=16)
    assert sizes.max() - sizes.min() <= 4
    w, b = nb.fit(x, 16, nb.Params())
    assert np.bincount(nb.route(x, (w, b), {}, nb.Params(probes=1))[0][:, 0], minlength=16).max() <= 3 * len(x) / 16
