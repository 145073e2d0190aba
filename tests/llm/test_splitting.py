import random

from conftest import clash
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwise.llm import splitting as sp

S = "chunk_id string, source string, heading_path array<string>, chunk_index int, content string"


def check(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in pieces) == text
    for (s, b, e), before in zip(pieces, [None, *pieces]):
        assert e - s <= limit and 0 <= b - s <= overlap
        assert before is None or (s >= before[0] and b == before[2])
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n\u0301é🧭#-", max_size=900), st.integers(40, 120), st.integers(0, 20))
def test_round_trip_and_limits(text, limit, overlap):
    check(text, limit, overlap)


def prose(n, seed=1):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["alpha", "beta.", "gamma\n\n", "delta,", "epsilon"]) for _ in range(n))


def test_cuts_are_natural():
    text = prose(3000)
    pieces = check(text, 2000, 200)
    assert all(text[b - 1] in "\n " for _, b, _ in pieces[1:])
    assert all(100 <= b - s <= 200 for s, b, _ in pieces[1:])


def test_edits_move_neighbouring_cuts_only():
    text = prose(6000)
    other = text[:300] + "inserted words here " + text[300:]
    a = {text[b:e] for _, b, e in sp.split_text(text)}
    b = {other[b:e] for _, b, e in sp.split_text(other)}
    assert len(a - b) <= 4 and len(a) > 12


def test_text_without_boundaries():
    check("x" * 50_000, 2000, 200)
    check("あ" * 5_000, 2000, 200)
    assert sp.split_text("") == [(0, 0, 0)]


def test_rows(spark):
    rows = [("a", "s", ["h"], 0, prose(1000)), ("a", "s", ["h"], 0, prose(1000)), ("b", "s", None, 1, "short"), ("c", None, None, None, None), ("d", "s", None, 2, ""), (None, None, None, None, prose(900)), ("e", "s", None, 3, "y" * 300_000)]
    df = clash(spark.createDataFrame(rows, S), "piece", "n", "block", "first")
    pieces = sp.split_chunks(df)
    got = pieces.collect()
    assert {r["chunk_id"] for r in got} == {"a", None, "e"} and all(len(r["piece"]) <= 2000 for r in got)
    one = sorted((r["piece_index"], r["overlap_chars"], r["piece"]) for r in got if r["chunk_id"] == "a")
    assert "".join(p[o:] for _, o, p in one) == rows[0][4] and [i for i, *_ in one] == list(range(len(one)))
    index = sp.new_indexes(df, pieces).where("source = 's'").orderBy("new_index").collect()
    assert [r["new_index"] for r in index] == list(range(len(index))) and [r["chunk_id"] for r in index[: len(one)]] == ["a"] * len(one)
    assert sp.split_chunks(df.where("false")).count() == 0
    assert sp.split_chunks(df, oversized_only=False).where("chunk_id = 'b'").first()["piece"] == "short"
