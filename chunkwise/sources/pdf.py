"""Positioned text elements of pages to Markdown-like text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Tolerances in points and the shares that the rules compare with."""

    row: float = 3.0
    gap: float = 12.0
    word: float = 1.5
    paragraph: float = 1.6
    column: float = 40.0
    max_pages: int = 0


@dataclass
class Element:
    page: int
    x: float
    y: float
    end_x: float
    size: float
    font: str
    text: str

    @property
    def bold(self) -> bool:
        return "bold" in self.font.lower() or "black" in self.font.lower()

    @property
    def mono(self) -> bool:
        return bool(re.search(r"(?i)mono|courier|consol", self.font))


#: Ligatures, quotes, dashes and blanks as they are written out.
GLYPHS = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", " ": " ", "­": "", "​": ""})
LIST = re.compile(r"^(?:[•●▪◦–*-]|\d+[.)]|[a-z][.)])\s+")


def mode(values: list):
    """Most frequent value, the smallest of equals."""
    c = Counter(values)
    return min(c, key=lambda v: (-c[v], v)) if c else None


def repeated(elements: list[Element]) -> set[tuple]:
    """Places and texts found on at least ``max(2, pages / 3)`` pages: running heads and feet."""
    pages = {e.page for e in elements}
    on: dict[tuple, set] = {}
    for e in elements:
        on.setdefault((round(e.x), round(e.y), e.text.strip()), set()).add(e.page)
    return {k for k, p in on.items() if len(p) >= max(2, len(pages) // 3)}


def rows_of(elements: list[Element], o: Options) -> list[list[Element]]:
    """Elements of one page as rows: y within the tolerance of the row's first element; rows from left to right."""
    out: list[list[Element]] = []
    for e in sorted(elements, key=lambda e: (e.y, e.x)):
        if out and abs(e.y - out[-1][0].y) <= o.row:
            out[-1].append(e)
        else:
            out.append([e])
    return [sorted(r, key=lambda e: e.x) for r in out]


def columns_of(elements: list[Element], o: Options) -> list[list[Element]]:
    """Split a page at a vertical gap that no element crosses and that has a fifth of the elements on both sides."""
    if len(elements) < 8:
        return [elements]
    left, right = min(e.x for e in elements), max(e.end_x for e in elements)
    best = None
    for i in range(1, 50):
        x = left + (right - left) * i / 50
        if any(e.x < x - o.gap / 2 < e.end_x or e.x < x + o.gap / 2 < e.end_x for e in elements):
            continue
        a = sum(e.end_x <= x for e in elements)
        if min(a, len(elements) - a) >= len(elements) / 5 and (best is None or abs(i - 25) < abs(best[0] - 25)):
            best = (i, x)
    if best is None or len({round(e.y) for e in elements if e.x > best[1]}) < 3 or looks_like_table(elements, o):
        return [elements]
    return [[e for e in elements if e.x < best[1]], [e for e in elements if e.x >= best[1]]]


def looks_like_table(elements: list[Element], o: Options) -> bool:
    rows = rows_of(elements, o)
    wide = [cells_of(r, o) for r in rows]
    return sum(len(c) >= 3 for c in wide) >= max(2, len(rows) / 2)


def join(row: list[Element], o: Options) -> str:
    out = ""
    for i, e in enumerate(row):
        if i and e.x - row[i - 1].end_x > o.word and not out.endswith(" ") and not e.text.startswith(" "):
            out += " "
        out += e.text
    return re.sub(r"\s+", " ", out.translate(GLYPHS)).strip()


def cells_of(row: list[Element], o: Options) -> list[str]:
    """Texts of a row, cut at wide gaps."""
    groups: list[list[Element]] = []
    for e in row:
        if groups and e.x - groups[-1][-1].end_x <= o.gap:
            groups[-1].append(e)
        else:
            groups.append([e])
    return [join(g, o) for g in groups]


NUMBERED = re.compile(r"(\d+(?:\.\d+)*)[.)]?\s+\S")


def heading_styles(elements: list[Element], body: float) -> dict[tuple[float, bool], int]:
    """Level of each font style ``(size, bold)`` that stands out from running text, by rank: the largest is 1, bold stands
    before regular of the same size; ranks beyond six are 6.

    A style stands out if it is larger than the body, or bold in about its size, and sets less than a third of the text.
    """
    used: Counter = Counter()
    for e in elements:
        used[style(e)] += len(e.text.strip())
    whole = sum(used.values())
    out = [s for s, n in used.items() if 3 * n < whole and (s[0] >= body + 0.8 or (s[1] and s[0] >= body - 0.5))]
    return {s: min(6, i + 1) for i, s in enumerate(sorted(out, key=lambda s: (-s[0], not s[1])))}


def style(e: Element) -> tuple[float, bool]:
    return round(e.size, 1), e.bold


def heading_level(row: list[Element], text: str, styles: dict[tuple[float, bool], int]) -> int | None:
    """Level of a row set in one heading style; a numbered title is as deep as its number, below the title of the whole.

    Rows of code and rows that end like a sentence are none."""
    level = styles.get(style(row[0]))
    if level is None or len({style(e) for e in row}) > 1 or any(e.mono for e in row) or not any(c.isalpha() for c in text) or text.endswith((".", ",", ";")):
        return None
    numbered = NUMBERED.match(text)
    return min(6, 2 + numbered.group(1).count(".")) if numbered else level


def repair(lines: list[str]) -> str:
    """Lines of a paragraph as one, words cut at line ends joined."""
    out = ""
    for line in lines:
        if out.endswith("-") and line[:1].islower():
            out = out[:-1] + line
        else:
            out = f"{out} {line}" if out else line
    return out


def pages_to_markdown(elements: list[Element], o: Options = Options()) -> str:
    """Markdown of a document: running heads, feet and page numbers dropped, columns read one after the other, headings
    by the rank of their font style, code of monospaced rows, lists, tables of aligned cells, paragraphs with hyphens repaired."""
    elements = [e for e in elements if e.text.strip() and (not o.max_pages or e.page <= o.max_pages)]
    if not elements:
        return ""
    gone = repeated(elements) if len({e.page for e in elements}) > 1 else set()
    kept = [e for e in elements if (round(e.x), round(e.y), e.text.strip()) not in gone]
    body = mode([round(e.size, 1) for e in kept or elements for _ in e.text.strip()])
    styles = heading_styles([e for e in kept if not e.mono], body)
    out: list[str] = []
    for page in sorted({e.page for e in kept}):
        mine = [e for e in kept if e.page == page]
        low, high = min(e.y for e in mine), max(e.y for e in mine)
        mine = [e for e in mine if not (re.fullmatch(r"(?:page\s*)?\d{1,4}|[ivxl]{1,6}", e.text.strip(), re.I) and (e.y in (low, high)) and e.size <= body * 1.05)]
        for column in columns_of(mine, o):
            rows = rows_of(column, o)
            i = 0
            para: list[str] = []
            last = None

            def flush() -> None:
                nonlocal para
                if para:
                    out.append(repair(para))
                para = []

            while i < len(rows):
                row = rows[i]
                text = join(row, o)
                level = heading_level(row, text, styles)
                if level:
                    flush()
                    if out and out[-1].startswith("#" * level + " ") and last is not None and row[0].y - last <= row[0].size * o.paragraph and i and level == 1:
                        out[-1] += " " + text
                    else:
                        out.append("#" * level + " " + text)
                elif all(e.mono for e in row):
                    flush()
                    code = []
                    left = row[0].x
                    while i < len(rows) and all(e.mono for e in rows[i]):
                        left = min(left, rows[i][0].x)
                        code.append(rows[i])
                        i += 1
                    width = max(1.0, code[0][0].size * 0.6)
                    out.append("```\n" + "\n".join(" " * round((r[0].x - left) / width) + join(r, o) for r in code) + "\n```")
                    last = code[-1][0].y
                    continue
                elif len(cells_of(row, o)) >= 2 and i + 1 < len(rows) and len(cells_of(rows[i + 1], o)) == len(cells_of(row, o)):
                    flush()
                    table = []
                    while i < len(rows) and len(cells_of(rows[i], o)) == len(cells_of(row, o)):
                        table.append("| " + " | ".join(cells_of(rows[i], o)) + " |")
                        i += 1
                    table.insert(1, "| " + " | ".join("---" for _ in cells_of(row, o)) + " |")
                    out.append("\n".join(table))
                    last = rows[i - 1][0].y
                    continue
                elif LIST.match(text):
                    flush()
                    mark = re.sub(r"^[•●▪◦–*-]\s+", "- ", text)
                    if out and re.match(r"^(?:- |\d+[.)] |[a-z][.)] )", out[-1].split("\n")[-1]):
                        out[-1] += "\n" + mark
                    else:
                        out.append(mark)
                else:
                    if para and last is not None and row[0].y - last > row[0].size * o.paragraph:
                        flush()
                    para.append(text)
                last = row[0].y
                i += 1
            flush()
    return "\n\n".join(out)


def documents_to_markdown(elements: DataFrame, o: Options = Options()) -> DataFrame:
    """``(doc_id, markdown)`` from ``elements(doc_id, page, x, y, end_x, size, font, text)``; documents are independent."""
    def run(frames):
        for pdf in frames:
            said = [pages_to_markdown([Element(r["page"], r["x"], r["y"], r["end_x"], r["size"], r["font"] or "", r["text"] or "") for r in es], o) for es in pdf["es"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "markdown": said})

    cols = F.struct("page", "y", "x", "end_x", "size", "font", "text")
    whole = elements.select("doc_id", cols.alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return whole.mapInPandas(run, "doc_id bigint, markdown string")


def repeated_elements(elements: DataFrame) -> DataFrame:
    """``(doc_id, text, pages)``: texts at one place on at least ``max(2, pages / 3)`` pages, natively."""
    per = elements.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    same = elements.groupBy("doc_id", F.round("x").alias("x"), F.round("y").alias("y"), F.trim("text").alias("text")).agg(F.count_distinct("page").alias("pages"))
    return same.join(per, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))).select("doc_id", "text", "pages")
