"""Word, PowerPoint and Excel files (the zipped XML formats) to Markdown-like text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

#: Fixed value: first bytes of the old compound format, in which encrypted files are wrapped.
COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")


def is_encrypted(data: bytes) -> bool:
    return data[:8] == COMPOUND


def name(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def attr(e, key: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == key), None)


def find(e, *path: str) -> list:
    out = [e]
    for p in path:
        out = [c for x in out for c in x if name(c) == p]
    return out


def text_of(e) -> str:
    out = []
    for x in e.iter():
        n = name(x)
        out.append(x.text or "" if n == "t" else "\t" if n == "tab" else "\n" if n in ("br", "cr") else "")
    return "".join(out)


def parts(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def xml(z: zipfile.ZipFile, part: str):
    return ElementTree.fromstring(z.read(part)) if part in z.namelist() else None


def docx_to_markdown(data: bytes) -> str:
    """Body in order: heading styles as ``#``, tables with a rule after the first row, then foot- and endnotes."""
    z = parts(data)
    out: list[str] = []
    for e in find(xml(z, "word/document.xml"), "body")[0]:
        if name(e) == "p":
            style = next((attr(s, "val") or "" for s in find(e, "pPr", "pStyle")), "")
            m = re.fullmatch(r"(?i)(?:heading|berschrift|titre)\s*([1-6])", style)
            said = text_of(e).strip()
            if said:
                out.append("#" * int(m.group(1)) + " " + said if m else said)
        elif name(e) == "tbl":
            rows = [["  ".join(text_of(p).strip() for p in find(c, "p")) for c in find(r, "tc")] for r in find(e, "tr")]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            if lines:
                lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
                out.append("\n".join(lines))
    for part, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
        root = xml(z, part)
        out += [t for n in (find(root, tag) if root is not None else []) if not attr(n, "type") and (t := text_of(n).strip())]
    return "\n\n".join(out)


def pptx_to_markdown(data: bytes) -> str:
    """``## Slide N: title`` (the first shape with text), the other shapes, then the notes of each slide."""
    z = parts(data)
    slides = sorted((int(m.group(1)), p) for p in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", p)))
    out = []
    for i, (n, part) in enumerate(slides, 1):
        shapes = [x for e in xml(z, part).iter() if name(e) == "sp" if (x := "\n".join(t for p in e.iter() if name(p) == "p" and (t := text_of(p).strip())))]
        title, *body = shapes or [""]
        block = [f"## Slide {i}: {title}" if title else f"## Slide {i}", *body]
        notes = xml(z, f"ppt/notesSlides/notesSlide{n}.xml")
        if notes is not None:
            said = [t for p in notes.iter() if name(p) == "p" and (t := text_of(p).strip()) and not t.isdigit()]
            if said:
                block.append("Notes: " + "\n".join(said))
        out.append("\n\n".join(block))
    return "\n\n".join(out)


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """``(sheet, rows)`` of displayed cell text; rows of blanks only are left out."""
    z = parts(data)
    shared_root = xml(z, "xl/sharedStrings.xml")
    shared = [text_of(s) for s in find(shared_root, "si")] if shared_root is not None else []
    rels = {attr(r, "Id"): attr(r, "Target") for r in xml(z, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in find(xml(z, "xl/workbook.xml"), "sheets", "sheet"):
        target = rels[attr(sheet, "id")].lstrip("/")
        root = xml(z, target if target.startswith("xl/") else f"xl/{target}")
        rows = []
        for r in find(root, "sheetData", "row"):
            cells: list[str] = []
            for c in find(r, "c"):
                at = column_number(attr(c, "r")) if attr(c, "r") else len(cells)
                cells += [""] * (at - len(cells))
                v = next((x.text or "" for x in find(c, "v")), "")
                kind = attr(c, "t")
                cells.append(shared[int(v)] if kind == "s" and v else "".join(text_of(x) for x in find(c, "is")) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else v)
            if any(x.strip() for x in cells):
                rows.append(cells)
        out.append((attr(sheet, "name"), rows))
    return out


def xlsx_chunks(data: bytes, size: int, count) -> list[str]:
    """Per sheet: the first row as header, rows as tables within ``size`` tokens, under ``## Sheet``."""
    from chunkwise.operators.chunking import table_chunks

    return [f"## {sheet}\n{t}" for sheet, rows in xlsx_sheets(data) if rows for t in table_chunks(rows[0], rows[1:], size, count)]
