"""Cutting text into chunks within a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwise.functions.tokens import bpe_counter, counter
from chunkwise.functions.text import strip_front_matter
from chunkwise.operators.blocks import layout_blocks, sections

Count = Callable[[str], int]


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """``(<id>, chunk_index, n_words, chunk)``: windows of ``size`` words, each repeating ``overlap`` words of the one before.

    Native expressions only. Null, empty and blank texts give no chunk. The last window is not made of overlap alone.
    """
    step = size - overlap
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: F.length(w) > 0)
    rows = df.select(id_col, words.alias("w")).where(F.size("w") > 0)
    n = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step)).cast("int")
    rows = rows.select(id_col, "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    piece = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return rows.select(id_col, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.size(piece).cast("bigint").alias("n_words"), F.array_join(piece, " ").alias("chunk"))


def token_split(text: str, size: int, min_chars: int = 0, min_length: int = 5, most: int = 10_000) -> list[str]:
    """Cut by byte-pair tokens: take ``size`` tokens, cut behind the last sentence end or line end if it lies behind
    character ``min_chars``, trim, keep if longer than ``min_length``, go on behind the kept text."""
    enc = bpe_counter()
    ids = enc.encode_ordinary(text)
    out: list[str] = []
    while ids and len(out) < most:
        part = enc.decode(ids[:size])
        if not part.strip():
            ids = ids[size:]
            continue
        cut = max(part.rfind(c) for c in ".?!\n")
        if cut != -1 and cut > min_chars:
            part = part[: cut + 1]
        kept = part.strip()
        if len(kept) > min_length:
            out.append(kept)
        ids = ids[max(1, len(enc.encode_ordinary(part))) :]
    if ids:
        rest = enc.decode(ids).strip()
        if len(rest) > min_length:
            out.append(rest)
    return out


def word_split(text: str, size: int, min_length: int = 0) -> list[str]:
    words = text.split()
    return [p for p in (" ".join(words[i : i + size]) for i in range(0, len(words), size)) if len(p) > min_length]


def splitter(name: str) -> Callable[[str, int], list[str]]:
    return (lambda t, n: word_split(t, n)) if name == "words" else (lambda t, n: token_split(t, n, 0, 1))


def pack_section(body: str, prefix: str, size: int, count: Count, split: Callable[[str, int], list[str]], strict: bool = True) -> list[str]:
    """Pieces of one section: layout blocks packed greedily while ``prefix`` and pieces stay within ``size`` tokens.

    A rule ends a piece. A block that alone is too large: bullets go item by item, tables, fences and quotes stay whole,
    paragraphs (and items) are split by tokens of the full ``size``. Every piece gets the prefix line.
    """
    budget = size - (count(prefix + "\n") if prefix else 0)
    out: list[str] = []
    buffer = ""

    def flush() -> None:
        nonlocal buffer
        if buffer:
            out.append(buffer)
        buffer = ""

    def add(text: str, oversize: Callable[[str], list[str]]) -> None:
        nonlocal buffer
        candidate = f"{buffer}\n{text}" if buffer else text
        if count(candidate) <= budget:
            buffer = candidate
            return
        flush()
        if count(text) <= budget:
            buffer = text
        else:
            out.extend(oversize(text))

    for kind, text, items in layout_blocks(body, strict):
        if kind == "rule":
            flush()
        elif kind == "bullets" and count(text) > budget:
            for item in items:
                add(item, lambda t: split(t, size))
        elif kind in ("table", "fence", "quote"):
            add(text, lambda t: [t])
        else:
            add(text, lambda t: split(t, size))
    flush()
    return [f"{prefix}\n{p}" if prefix else p for p in out]


def pack_lines(lines: Column, weights: Column, budget: int) -> Column:
    """Greedy packing of an array of texts with additive weights, as a native fold: array of joined texts.

    Items join with newlines while their weights sum to at most ``budget``; an item above it stands alone.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n"))

    def step(s, x):
        fits = s["text"].isNotNull() & (s["n"] + x["n"] <= budget)
        return F.struct(
            F.when(fits | s["text"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["text"])).alias("done"),
            F.when(fits, F.concat(s["text"], F.lit("\n"), x["t"])).otherwise(x["t"]).alias("text"),
            F.when(fits, s["n"] + x["n"]).otherwise(x["n"]).cast("bigint").alias("n"),
        )

    items = F.zip_with(lines, weights, lambda t, n: F.struct(t.alias("t"), n.cast("bigint").alias("n")))
    return F.aggregate(items, start, step, lambda s: F.when(s["text"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["text"])))


def table_chunks(header: list[str], rows: list[list[str]], size: int, count: Count) -> list[str]:
    """Markdown tables of whole rows within ``size`` tokens; the header is repeated; a row too large stands alone."""
    if not rows:
        return []
    head = "| " + " | ".join(header) + " |\n| " + " | ".join("---" for _ in header) + " |"
    out, current = [], head
    for r in rows:
        line = "| " + " | ".join(r) + " |"
        if current != head and count(f"{current}\n{line}") > size:
            out.append(current)
            current = head
        current = f"{current}\n{line}"
    out.append(current)
    return out


def table_chunks_native(df: DataFrame, group: list[str], order: list[str], columns: list[str], budget: int) -> DataFrame:
    """``(<group>, chunk_index, n_rows, chunk)``: rows of each group as Markdown tables packed by word counts, natively."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"
    rows = df.select(*group, F.struct(*order, cells.alias("_line")).alias("x")).groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    lines = F.transform("xs", lambda x: x["_line"])
    weights = F.transform("xs", lambda x: F.size(F.split(x["_line"], " ")))
    packed = rows.select(*group, F.posexplode(pack_lines(lines, weights, budget - len(head.split()))).alias("chunk_index", "body"))
    n = F.size(F.split("body", "\n"))
    return packed.select(*group, F.col("chunk_index").cast("bigint").alias("chunk_index"), n.cast("bigint").alias("n_rows"), F.concat(F.lit(head + "\n"), "body").alias("chunk"))


def to_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000, min_chars: int = 200, tokens: str = "bpe", strict: bool = True) -> DataFrame:
    """``(<id>, chunk_index, heading_title, heading_level, heading_path, chunk)`` of Markdown texts.

    Front matter is removed, sections are cut at headings, and each section is packed to ``size``
    tokens (``bpe``: public byte-pair vocabulary, ``words``: white space). A text without any heading section is split by
    tokens alone. Null, empty and blank texts give no chunk; chunk indexes are dense from 0 in reading order.
    """
    src = df.select(F.col(id_col), strip_front_matter(text_col).alias("_text")).where(F.length(F.trim("_text")) > 0)
    kind = dict(df.dtypes)[id_col]

    def run(frames):
        count, split = counter(tokens), splitter(tokens)
        for pdf in frames:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                index = 0
                parts = sections(text)
                for _, level, title, path, body in parts:
                    if level is None and len(parts) == 1:
                        pieces = token_split(body, size, min_chars, 5) if tokens == "bpe" else word_split(body, size)
                    else:
                        pieces = pack_section(body, "#" * level + " " + title if level else "", size, count, split, strict)
                    for x in pieces:
                        rows.append((key, index, title, level, path, x))
                        index += 1
            out = pd.DataFrame(rows, columns=["id", "chunk_index", "heading_title", "heading_level", "heading_path", "chunk"])
            out["heading_level"] = out["heading_level"].astype("Int32")
            yield out

    whole = src.select(F.col(id_col).alias("id"), F.col("_text").alias("text")).where("id IS NOT NULL")
    got = whole.mapInPandas(run, f"id {kind}, chunk_index int, heading_title string, heading_level int, heading_path array<string>, chunk string")
    return got.withColumnRenamed("id", id_col)


COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
