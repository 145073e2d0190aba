import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwise.functions.tokens import bpe_counter, word_count
from chunkwise.operators import blocks, chunking

D = "doc_id long, text string"


def test_heading_paths(spark):
    text = "intro\n# A\na\n### C\nc\n## B\nb\n# D\n\n"
    got = blocks.heading_sections(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain")], D), "doc_id", "text").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["heading_path"], r["body"]) for r in got] == [(1, [], "intro"), (1, ["A"], "a"), (1, ["A", "C"], "c"), (1, ["A", "B"], "b"), (4, [], "plain")]


def test_layout_blocks_and_fence_rule():
    text = "para\nmore\n\n- a\n- b\n> q\n---\n| x |\n| y |\n```\ncode\n```\ntail"
    assert [k for k, _, _ in blocks.layout_blocks(text)] == ["paragraph", "bullets", "quote", "rule", "table", "fence"]
    assert [k for k, _, _ in blocks.layout_blocks(text, strict=False)][-2:] == ["fence", "paragraph"]
    assert blocks.layout_blocks("") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab -|>`\n", max_size=30), max_size=6), st.integers(3, 12))
def test_pieces_stay_within_budget_and_lose_no_word(parts, size):
    body = "\n".join(parts)
    pieces = chunking.pack_section(body, "# h", size, word_count, lambda t, n: chunking.word_split(t, n))
    said = " ".join(p.split("\n", 1)[1] for p in pieces).split()
    kept = " ".join(t for k, t, _ in blocks.layout_blocks(body) if k != "rule").split()
    assert said == kept


def test_table_chunks():
    got = chunking.table_chunks(["a", "b"], [["1", "2"], ["3", "4"], ["x " * 50, "y"]], 18, word_count)
    assert all(t.startswith("| a | b |\n| --- | --- |\n") for t in got) and len(got) == 3 and "| 1 | 2 |" in got[0]
    assert chunking.table_chunks(["a"], [], 10, word_count) == []


def test_native_packing_equals_a_loop(spark):
    rnd = random.Random(3)
    rows = [(i, ["w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 15))]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, xs array<string>")
    got = {r["id"]: r["p"] for r in df.select("id", chunking.pack_lines(F.col("xs"), F.transform("xs", F.length), 12).alias("p")).collect()}
    for i, xs in rows:
        want, n = [], 0
        for x in xs:
            if want and n + len(x) <= 12:
                want[-1] += "\n" + x
                n += len(x)
            else:
                want.append(x)
                n = len(x)
        assert got[i] == want


def test_word_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, " "), (3, None)], D)
    got = [(r["chunk_index"], r["chunk"]) for r in chunking.word_windows(df, "doc_id", "text", 3, 1).orderBy("chunk_index").collect()]
    assert got == [(0, "a b c"), (1, "c d e")]


def test_token_split_keeps_budget():
    text = "One sentence here. " * 60
    enc = bpe_counter()
    parts = chunking.token_split(text, 40, 20)
    assert all(len(enc.encode_ordinary(p)) <= 40 for p in parts) and " ".join(parts) == text.strip()
    assert chunking.token_split("", 10) == []


def test_to_chunks(spark):
    df = spark.createDataFrame([(1, "---\nt: 1\n---\n# A\nx y z\n## B\n" + "w " * 30), (2, "plain words only"), (3, None), (4, " ")], D)
    got = chunking.to_chunks(df, "doc_id", "text", 10, 0, "words").orderBy("doc_id", "chunk_index").collect()
    one = [r for r in got if r["doc_id"] == 1]
    assert one[0]["chunk"] == "# A\nx y z" and one[1]["heading_path"] == ["A", "B"] and [r["chunk_index"] for r in one] == list(range(len(one)))
    assert [r["chunk"] for r in got if r["doc_id"] == 2] == ["plain words only"] and {r["doc_id"] for r in got} == {1, 2}
