import random

import pytest
from conftest import clash

from chunkwise.llm import encode as en

TEXTS = [None, "", " ", "\n\n", "Hello world's  end.\r\n\tx", "<|endoftext|> as text", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "naïve café — 日本語のテキスト 🧭👩‍🔬", "1234567 3.14 0xff", "  lead", "trail   ", "a  b   c\n d", "\x00\x1c\x85\xa0x \xa0y", "===== ----", "don't I'LL we've", "é" * 300]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(en.VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_same_ids_as_the_public_library(spark, reference):
    rnd = random.Random(7)
    made = ["".join(rnd.choice("abcdeABC 123.,'\n\té日🧭") for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    texts = TEXTS + made + ["".join(rnd.choice("abcdefghijklmnop") for _ in range(3000)), "word " * 30000]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "ids", "tokens", "words")
    got = {r["doc_id"]: r["ids"] for r in en.encode_corpus(df, batch=5000).collect()}
    assert len(got) == len(texts) and all(got[i] == reference(t) for i, t in enumerate(texts))
    counts = {r["doc_id"]: r["tokens"] for r in en.token_counts(df, ["doc_id"]).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted(map(str, (r["ids"] for r in en.encode_corpus(df).collect()))) == ["[64, 275]"] * 3
    assert en.encode_corpus(df.where("false")).count() == 0


def test_small_cache_changes_nothing(reference):
    coder = en.DuckEncoder(cache=5)
    for t in TEXTS * 2:
        flat, n = coder.encode([t])
        assert flat.tolist() == reference(t) and n[0] == len(flat)


def test_long_words_in_segments_equal_the_library():
    import random

    from tokenizers import Tokenizer

    coder, library, rnd = en.DuckEncoder(), Tokenizer.from_file(en.VOCABULARY), random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rnd.choice(x) for _ in range(n)) for x, n in (("etaoinshrdlu", 3000), (letters, 2000), ("абвгдежзик", 900), (("information", "table", "ing", "retr"), 400))]
    for text in [*texts, "a" * 4000, "ab" * 1500, f"x {texts[1]} y"]:
        ids, counts = coder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_ambiguous_vocabulary_takes_the_general_way():
    coder = en.DuckEncoder()
    assert coder.unambiguous
    want = coder.encode(["x" + "abcdefgh" * 9])[0].tolist()
    coder.reset()
    coder.unambiguous = False
    assert coder.encode(["x" + "abcdefgh" * 9])[0].tolist() == want
