"""Structure of Markdown-like text: heading sections with their paths, and layout blocks. Both are folds over one text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = r"^(#{1,6})\s+(.+)$"


MARKER = re.compile(HEADING, re.A)


def sections(text: str) -> list[tuple[int, int | None, str | None, list[str], str]]:
    """``(section, level, title, path, body)`` of every heading section of a text that holds text, in order.

    Every heading line opens a section, inside code fences too. The path holds the headings above that no later heading
    of the same or a smaller level has ended. Text before the first heading is section 0 without heading."""
    out: list = []
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    number = 0

    def close() -> None:
        body = "\n".join(lines).strip(" \t\n\r\f\v")
        lines.clear()
        if body:
            level, title = stack[-1] if number else (None, None)
            out.append((number, level, title, [t for _, t in stack], body))

    for line in text.replace("\r\n", "\n").split("\n"):
        m = MARKER.match(line)
        if not m:
            lines.append(line)
            continue
        close()
        level = len(m.group(1))
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, m.group(2).strip(" ")))
        number += 1
    close()
    return out


def heading_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(<id>, section, heading_level, heading_title, heading_path, body)``: one row per heading section with text.

    Each text is cut where it lies, over Arrow batches: no line is shuffled and texts are independent of one another.
    Bodies are trimmed; empty ones, null texts and null ids give no row. See :func:`sections`.
    """
    def run(frames):
        for pdf in frames:
            rows = [(i, *s) for i, t in zip(pdf["id"], pdf["text"]) for s in sections(t)]
            got = pd.DataFrame(rows, columns=["id", "section", "heading_level", "heading_title", "heading_path", "body"])
            yield got.astype({"heading_level": "Int32"})

    kind = dict(df.dtypes)[id_col]
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return src.mapInPandas(run, f"id {kind}, section bigint, heading_level int, heading_title string, heading_path array<string>, body string").withColumnRenamed("id", id_col)


#: What a line of each kind of Markdown block begins with or holds.
FENCE_LINE, TABLE_LINE = re.compile(r"^(`{3,}|~{3,})"), re.compile(r"\|")
BULLET_LINE, QUOTE_LINE = re.compile(r"^([-*+] |\d+\. )"), re.compile(r"^>( |$)")
RULE_LINE = re.compile(r"^(-{3,}|_{3,}|\*{3,})$")


def layout_blocks(text: str, strict: bool = True) -> list[tuple[str, str, list[str]]]:
    """Layout blocks ``(kind, text, items)`` of a text, in order.

    With ``strict`` a fence ends only at a line that begins with the same run *and*, blanks aside, differs from the opening line, so a
    bare fence is not closed by a bare fence; without it any such line closes. An unclosed fence runs to the end.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    out: list[tuple[str, str, list[str]]] = []
    i = 0

    def kind_of(line: str) -> str:
        if not line.strip():
            return "blank"
        for kind, test in (("fence", FENCE_LINE), ("table", TABLE_LINE), ("bullets", BULLET_LINE), ("quote", QUOTE_LINE)):
            if test.search(line):
                return kind
        return "rule" if RULE_LINE.match(line.strip()) else "paragraph"

    while i < len(lines):
        kind = kind_of(lines[i])
        if kind == "blank":
            i += 1
            continue
        j = i + 1
        if kind == "fence":
            run = FENCE_LINE.match(lines[i]).group(1)
            while j < len(lines) and not (lines[j].startswith(run) and (not strict or lines[j].strip() != lines[i].strip())):
                j += 1
            j = min(len(lines), j + 1)
        elif kind in ("table", "bullets", "quote"):
            test = {"table": TABLE_LINE, "bullets": BULLET_LINE, "quote": QUOTE_LINE}[kind]
            while j < len(lines) and lines[j].strip() and test.search(lines[j]):
                j += 1
        elif kind == "paragraph":
            while j < len(lines) and kind_of(lines[j]) == "paragraph":
                j += 1
        out.append((kind, "\n".join(lines[i:j]), list(lines[i:j]) if kind == "bullets" else []))
        i = j
    return out
