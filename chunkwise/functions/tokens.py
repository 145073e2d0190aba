"""Analysers and token counters."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"

#: The usual short list of English stop words of search engines.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def standard(text) -> Column:
    """Lower-case runs of letters, digits and underscores; null gives null."""
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def lowered(text) -> Column:
    """Lower-case text in which a Greek sigma is the same letter wherever it stands in a word."""
    return F.translate(F.lower(F.col(text) if isinstance(text, str) else text), "ς", "σ")


def english_words(text) -> Column:
    """Standard tokens without possessive endings and stop words, not yet stemmed."""
    toks = F.regexp_extract_all(F.regexp_replace(lowered(text), r"['’]s\b", ""), F.lit(TOKEN), F.lit(0))
    return F.filter(toks, lambda t: ~t.isin(*STOP_WORDS))


def stems(words) -> Column:
    """Porter stems of arrays of words; the stem of a word is looked up once per batch."""
    @F.arrow_udf("array<string>")
    def run(words: pa.Array) -> pa.Array:
        coded = pc.list_flatten(words).dictionary_encode()
        stem = pa.array([porter(w) for w in coded.dictionary.to_pylist()], pa.string())
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), stem.take(coded.indices), mask=words.is_null())

    return run(words)


def english(text) -> Column:
    """Analyser for English: possessives, stop words, Porter stems."""
    return stems(english_words(text))


def word_count(text) -> int:
    return len(text.split())


_BPE: dict = {}


def bpe_counter(path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"):
    """Exact byte-pair encoder of a public vocabulary, loaded once per process: object with ``encode`` and ``decode``."""
    if path not in _BPE:
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _BPE[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _BPE[path]


def counter(name: str = "words"):
    """Token counter by name: ``words`` (white space) or ``bpe`` (public byte-pair vocabulary)."""
    if name == "words":
        return word_count
    return lambda t: len(bpe_counter().encode_ordinary(t))


VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _forms(w: str) -> str:
    """Consonant/vowel pattern of a word, one letter per character."""
    out = []
    for i, c in enumerate(w):
        out.append("v" if c in "aeiou" or (c == "y" and i > 0 and out[i - 1] == "c") else "c")
    return "".join(out)


def _m(stem: str) -> int:
    return len(re.findall(r"v+c+", _forms(stem)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _forms(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: Suffixes of the second, third and fourth step of Porter's published algorithm.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Stem of a lower-case English word by Porter's published algorithm; short and non-ASCII words stay."""
    w = word
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _forms(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _forms(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _m(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _forms(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(suffix):
                if _m(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _m(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _m(base) > 1 or (_m(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w
