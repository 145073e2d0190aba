"""CSV, JSON lines, JSON and JSON with comments."""

from __future__ import annotations

import json
import re

from chunkwise.operators.chunking import Count, table_chunks


def csv_line(line: str) -> list[str]:
    """Cells of one line: quotes may hold commas, a doubled quote is a quote; a cell never runs over a line end."""
    cells, cell, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1 : i + 2] == '"':
            cell.append('"')
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            cells.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
        i += 1
    cells.append("".join(cell).strip())
    return cells


def csv_rows(text: str) -> list[list[str]]:
    """Rows of all lines that are not blank; lines are trimmed first."""
    return [csv_line(x.strip()) for x in text.splitlines() if x.strip()]


def csv_chunks(text: str, size: int, count: Count) -> list[str]:
    rows = csv_rows(text)
    return table_chunks(rows[0], rows[1:], size, count) if len(rows) > 1 else []


def jsonl_objects(text: str) -> list:
    """Values of the lines that are valid JSON; other lines are skipped."""
    out = []
    for line in text.splitlines():
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return out


class Value:
    """A parsed value: ``kind`` is object, array or scalar; ``notes`` are the comments before it, ``tail`` the one after
    it on the same line; ``raw`` is its source text."""

    __slots__ = ("kind", "items", "raw", "notes", "tail", "key")

    def __init__(self, kind: str, raw: str = "", items=None):
        self.kind, self.raw, self.items, self.notes, self.tail, self.key = kind, raw, items or [], [], "", None


TOKEN = re.compile(r'(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>"(?:[^"\\\n]|\\.)*")|(?P<word>[^\s{}\[\],:"/]+)|(?P<sign>[{}\[\],:])|(?P<blank>\s+)', re.S)


class JsoncParser:
    """Recursive descent over tokens; errors name the position. Trailing commas and comments are allowed."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise ValueError(f"invalid JSON at character {at}")
            if m.lastgroup != "blank":
                self.tokens.append((m.lastgroup, m.group(), m.start(), m.end()))
            at = m.end()
        self.i, self.preamble = 0, []

    def notes(self) -> list[str]:
        out = []
        while self.i < len(self.tokens) and self.tokens[self.i][0] == "note":
            out.append(self.tokens[self.i][1])
            self.i += 1
        return out

    def parse(self) -> Value:
        self.preamble = self.notes()
        v = self.value()
        self.notes()
        if self.i < len(self.tokens):
            raise ValueError(f"invalid JSON at character {self.tokens[self.i][2]}")
        return v

    def take(self, sign: str | None = None):
        if self.i >= len(self.tokens) or (sign and self.tokens[self.i][1] != sign):
            raise ValueError(f"invalid JSON at character {self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.source)}")
        self.i += 1
        return self.tokens[self.i - 1]

    def value(self) -> Value:
        kind, text, start, _ = self.take()
        if kind == "text" or (kind == "word" and re.fullmatch(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null", text)):
            return Value("scalar", text)
        if text not in ("{", "["):
            raise ValueError(f"invalid JSON at character {start}")
        close, v = ("}", Value("object")) if text == "{" else ("]", Value("array"))
        while True:
            notes = self.notes()
            if self.i < len(self.tokens) and self.tokens[self.i][1] == close:
                break
            key = None
            if close == "}":
                k = self.take()
                if k[0] != "text":
                    raise ValueError(f"invalid JSON at character {k[2]}")
                key = unquote(k[1])
                self.notes()
                self.take(":")
                self.notes()
            item = self.value()
            item.key, item.notes = key, notes
            end = self.tokens[self.i - 1][3]
            comma = self.i < len(self.tokens) and self.tokens[self.i][1] == ","
            if comma:
                self.i += 1
            if self.i < len(self.tokens) and self.tokens[self.i][0] == "note" and "\n" not in self.source[end : self.tokens[self.i][2]]:
                item.tail = self.tokens[self.i][1]
                self.i += 1
            v.items.append(item)
            if not comma:
                self.notes()
                break
        _, _, _, stop = self.take(close)
        v.raw = self.source[start:stop]
        return v


def unquote(text: str) -> str:
    """A string token as its text; other tokens, and strings with escapes JSON does not know, as they are written."""
    if not text.startswith('"'):
        return text
    try:
        return json.loads(text, strict=False)
    except ValueError:
        return text[1:-1]


def plain_note(note: str) -> str:
    body = note[2:] if note.startswith("//") else note[2:-2]
    return re.sub(r"\s+", " ", re.sub(r"(?m)^\s*\*+", "", body)).strip()


def flat(v: Value) -> str:
    """Fields of an object on one line; what is nested deeper stays as written."""
    return ", ".join(f"{x.key}: {unquote(x.raw)}" for x in v.items)


def fenced(v: Value) -> str:
    return f"```json\n{v.raw}\n```"


def field(v: Value) -> str | None:
    """A field as ``**key**: value``: scalars bare, their arrays by commas, arrays of objects by semicolons, mixed arrays
    and objects as fenced source below the key; None for an empty array."""
    if v.kind == "scalar":
        said = " " + unquote(v.raw)
    elif v.kind == "object":
        said = "\n" + fenced(v)
    else:
        kinds = {x.kind for x in v.items}
        if not kinds:
            return None
        said = " " + ", ".join(unquote(x.raw) for x in v.items) if kinds == {"scalar"} else " " + "; ".join(map(flat, v.items)) if kinds == {"object"} else "\n" + fenced(v)
    return f"**{v.key}**:{said}"


def with_notes(v: Value, said: str) -> str:
    """Comments before a value on a line above it, one on its own line behind it."""
    above = above_note(v)
    tail = plain_note(v.tail) if v.tail else ""
    return (f"{above}\n" if above else "") + said + (f" - {tail}" if tail else "")


def above_note(v: Value) -> str:
    return " ".join(n for n in map(plain_note, v.notes) if n)


def jsonc_chunks(source: str, size: int, count: Count) -> list[str]:
    """Sections within ``size`` tokens: ``## a -> b`` with the scalar fields of an object, ``## a -> Items 1-3`` with the
    elements of an array; invalid input raises ``ValueError``.

    Every object and array has sections of its own; objects in arrays are one chunk each, other elements are batched.
    Comments become prose above what they precede, or behind it if they end its line; comments before the root stand
    before every chunk and take part of its budget. A part above the budget stands alone; a scalar root gives nothing.
    """
    parser = JsoncParser(source)
    root = parser.parse()
    head = " ".join(n for n in map(plain_note, parser.preamble) if n)
    out = sections(root, [], size - count(head) if head else size, count)
    return [f"{head}\n\n{c}" for c in out] if head else out


def sections(v: Value, path: list[str], size: int, count: Count) -> list[str]:
    """Chunks of one object or array and of everything nested in it, in the order of the source."""
    if v.kind == "array":
        numbered = [(i, with_notes(x, element(x)), x.kind == "object") for i, x in enumerate(v.items, 1)]
        return packed(numbered, lambda lo, hi: "## " + " -> ".join([*path, f"Item {lo}" if lo == hi else f"Items {lo}-{hi}"]), size, count)
    out: list[str] = []
    run: list[tuple[int, str, bool]] = []
    title = " ".join(["##", " -> ".join(path)]).strip()
    for x in [*(v.items if v.kind == "object" else ()), None]:
        if x is not None and x.kind == "scalar":
            run.append((0, with_notes(x, field(x)), False))
            continue
        out += packed(run, lambda lo, hi: title, size, count)
        run = []
        if x is not None:
            below = sections(x, [*path, x.key], size, count)
            note = above_note(x)
            out += [f"{note}\n\n{below[0]}", *below[1:]] if note and below else below
    return out


def element(v: Value) -> str:
    if v.kind == "object":
        return "\n".join(f for f in map(field, v.items) if f) or "{}"
    return unquote(v.raw)


def packed(items: list[tuple[int, str, bool]], title, size: int, count: Count) -> list[str]:
    """Chunks of ``(number, text, alone)`` below ``title(first, last)``, as many as fit, by blank lines."""
    out: list[str] = []
    batch: list[tuple[int, str]] = []

    def text(b: list[tuple[int, str]]) -> str:
        return "\n\n".join([title(b[0][0], b[-1][0]), *(t for _, t in b)])

    for number, said, alone in items:
        if batch and (alone or count(text([*batch, (number, said)])) > size):
            out.append(text(batch))
            batch = []
        batch.append((number, said))
        if alone:
            out.append(text(batch))
            batch = []
    return [*out, text(batch)] if batch else out
