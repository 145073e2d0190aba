"""Declarations of Kotlin, Java, TypeScript and JavaScript sources, by a lexer and bracket matching."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from chunkwise.functions.tokens import counter
from chunkwise.operators.chunking import splitter

#: Language by file extension.
LANGUAGES = {"kt": "kotlin", "kts": "kotlin", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript"}


@dataclass
class Token:
    kind: str  # "comment", "code", "string", "blank"
    start: int
    end: int


@dataclass
class Declaration:
    type: str  # CLASS, METHOD, FUNCTION, CONSTRUCTOR
    name: str
    class_name: str | None
    package: str | None
    full_text: str
    imports: list[str] = field(default_factory=list)


def lex(text: str) -> list[Token]:
    """Cut source text of the C-like languages into comments, strings, blanks and single code characters or words.

    A state machine over the characters: line and block comments, ``"``, ``'`` and backtick strings with escapes,
    triple quotes. Unclosed strings end at their line, unclosed comments and triple quotes at the end of the text.
    """
    out: list[Token] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "/" and text.startswith("//", i):
            j = i
            while j < n and text[j] not in "\r\n":
                j += 1
            out.append(Token("comment", i, j))
        elif c == "/" and text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append(Token("comment", i, j))
        elif text.startswith('"""', i):
            j = text.find('"""', i + 3)
            j = n if j < 0 else j + 3
            out.append(Token("string", i, j))
        elif c in "\"'`":
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] not in "\r\n"):
                j += 2 if text[j] == "\\" else 1
            j = min(n, j + 1)
            out.append(Token("string", i, j))
        elif c.isspace():
            j = i
            while j < n and text[j].isspace():
                j += 1
            out.append(Token("blank", i, j))
        elif c.isalnum() or c in "_$@":
            j = i + 1
            while j < n and (text[j].isalnum() or text[j] in "_$"):
                j += 1
            out.append(Token("code", i, j))
        else:
            j = i + 1
            out.append(Token("code", i, j))
        i = j
    return out


#: What can follow a parameter list on the next line and still belong to the declaration.
CONTINUES = frozenset(("{", "=", ":", "-", "where", "throws", "(", "default"))


def skip_group(toks: list[Token], text: str, k: int) -> int:
    """Index behind the bracket group that opens at token ``k``; strings and comments inside do not count."""
    depth = 0
    while k < len(toks):
        t = toks[k]
        if t.kind == "code":
            c = text[t.start]
            depth += (c in "([{") - (c in ")]}")
            if depth == 0:
                return k + 1
        k += 1
    return k


def body_end(toks: list[Token], text: str, k: int) -> int:
    """Token index behind a body ``{...}``, a ``;`` or, for an expression body, the end of its line at depth 0."""
    seen_params = False
    while k < len(toks):
        t = toks[k]
        if t.kind == "code":
            c = text[t.start]
            if c == "{":
                return skip_group(toks, text, k)
            if c in "([":
                k = skip_group(toks, text, k)
                seen_params = True
                continue
            if c == ";":
                return k + 1
            if c == "}":
                return k
            if c == "=" and seen_params and not text.startswith("=>", t.start):
                while k < len(toks) and not (toks[k].kind == "blank" and "\n" in text[toks[k].start : toks[k].end]) and text[toks[k].start] not in ";}":
                    k = skip_group(toks, text, k) if toks[k].kind == "code" and text[toks[k].start] in "([{" else k + 1
                return k
        elif t.kind == "blank" and seen_params and "\n" in text[t.start : t.end]:
            n = k + 1
            while n < len(toks) and toks[n].kind != "code":
                n += 1
            if n < len(toks) and text[toks[n].start : toks[n].end] not in CONTINUES:
                return k
        k += 1
    return k


CLASS_WORDS = {"kotlin": ("class", "object", "interface"), "java": ("class", "interface", "enum", "record", "@interface"), "typescript": ("class", "interface"), "javascript": ("class",)}
#: Words in front of brackets that name no function.
CONTROL = frozenset("if for while switch catch when return new throw else do try synchronized super this".split())


class Parser:
    def __init__(self, text: str, language: str):
        self.text, self.language, self.toks = text, language, lex(text)
        self.package, self.imports, self.found = None, [], []

    def word(self, k: int) -> str:
        t = self.toks[k]
        return self.text[t.start : t.end]

    def next_code(self, k: int) -> int:
        while k < len(self.toks) and self.toks[k].kind in ("blank", "comment"):
            k += 1
        return k

    def parse(self) -> list[Declaration]:
        if self.language in ("kotlin", "java"):
            m = re.search(r"(?m)^\s*package\s+([\w.]+)", self.text)
            self.package = m.group(1) if m else None
            self.imports = [x.strip().rstrip(";") for x in re.findall(r"(?m)^[ \t]*import[ \t]+[^\n;]+;?", self.text)]
        self.block(0, len(self.toks), [])
        for d in self.found:
            d.imports = self.imports
        return self.found

    def lead(self, fresh: int, k: int) -> int:
        """Offset at which a declaration begins: its comments of the right kind, annotations and modifiers."""
        start = None
        for i in range(fresh, k + 1):
            t = self.toks[i]
            if t.kind == "blank":
                continue
            if t.kind == "comment":
                body = self.text[t.start : t.end]
                if not body.startswith("/*") or (self.language == "java" and not body.startswith("/**")):
                    start = None if start is None or self.toks[i].kind == "comment" else start
                    continue
                if start is None or self.text[start] == "/":
                    start = t.start
                continue
            if start is None:
                start = t.start
        return self.toks[k].start if start is None else start

    def block(self, k: int, end: int, classes: list[str]) -> None:
        fresh = k
        while k < end:
            t = self.toks[k]
            if t.kind != "code":
                k += 1
                continue
            w = self.word(k)
            if w in ("{", "(", "["):
                k = skip_group(self.toks, self.text, k)
                if w == "{":
                    fresh = k
                continue
            if w in (";", "}"):
                k += 1
                fresh = k
                continue
            if w in ("package", "import") and not classes:
                while k < end and not (self.toks[k].kind == "blank" and "\n" in self.text[self.toks[k].start : self.toks[k].end]) and self.word(k) != ";":
                    k += 1
                fresh = k
                continue
            if w[0] == "@" and w != "@interface":
                k += 1
                while k + 1 < end and self.toks[k].kind == "code" and self.word(k) in ".:":
                    k += 2
                if k < end and self.toks[k].kind == "code" and self.word(k) == "(":
                    k = skip_group(self.toks, self.text, k)
                continue
            if w in CLASS_WORDS[self.language]:
                j = self.next_code(k + 1)
                if j < end and self.toks[j].kind == "code" and (self.word(j)[0].isalpha() or self.word(j)[0] in "_$") or w == "object":
                    k = fresh = self.class_at(fresh, k, j, end, classes)
                    continue
            if self.language == "kotlin" and w in ("val", "var", "typealias"):
                k = self.property_end(k, end)
                fresh = k
                continue
            got = self.function_at(fresh, k, end, classes)
            if got:
                k = fresh = got
                continue
            k += 1

    def property_end(self, k: int, end: int) -> int:
        while k < end:
            t = self.toks[k]
            if t.kind == "code" and self.word(k) in ("{", "(", "["):
                k = skip_group(self.toks, self.text, k)
                continue
            if t.kind == "blank" and "\n" in self.text[t.start : t.end] or (t.kind == "code" and self.word(k) in (";", "}")):
                return k
            k += 1
        return k

    def class_at(self, fresh: int, k: int, j: int, end: int, classes: list[str]) -> int:
        name = self.word(j) if j < end and (self.word(j)[0].isalpha() or self.word(j)[0] in "_$") else "Companion"
        path = [*classes, name]
        start = self.lead(fresh, k)
        i = j
        while i < end and not (self.toks[i].kind == "code" and self.word(i) == "{"):
            if self.toks[i].kind == "code" and self.word(i) in "([":
                i = skip_group(self.toks, self.text, i)
                continue
            if self.toks[i].kind == "code" and self.word(i) in (";", "}"):
                break
            if self.toks[i].kind == "blank" and "\n" in self.text[self.toks[i].start : self.toks[i].end]:
                n = self.next_code(i)
                if n >= end or self.word(n) not in ("{", ":", ",", "extends", "implements", "where", "permits", "("):
                    break
            i += 1
        here = len(self.found)
        if i < end and self.word(i) == "{" and self.toks[i].kind == "code":
            stop = skip_group(self.toks, self.text, i)
            self.found.append(Declaration("CLASS", ".".join(path), ".".join(classes) or None, self.package, ""))
            self.block(i + 1, stop - 1, path)
            text = self.text[start : self.toks[stop - 1].end]
            for d in self.found[here + 1 :]:
                if d.type == "CLASS" and d.class_name == ".".join(path):
                    at = text.find(d.full_text.split("{", 1)[0])
                    whole = text[at : at + len(getattr(d, "source", d.full_text))]
                    if at >= 0 and "{" in whole:
                        text = text.replace(whole, whole.split("{", 1)[0] + "{ /* ... */ }", 1)
            self.found[here].source = self.text[start : self.toks[stop - 1].end]
        else:
            stop = i
            text = self.text[start : self.toks[max(j, stop - 1)].end]
            self.found.append(Declaration("CLASS", ".".join(path), ".".join(classes) or None, self.package, ""))
        self.found[here].full_text = text
        return stop

    def function_at(self, fresh: int, k: int, end: int, classes: list[str]) -> int | None:
        w = self.word(k)
        if not (w[0].isalpha() or w[0] in "_$") or w in CONTROL:
            return None
        if self.language == "kotlin":
            if w == "constructor" and classes:
                j = self.next_code(k + 1)
                if j < end and self.word(j) == "(":
                    return self.add("CONSTRUCTOR", classes[-1], fresh, k, j, classes)
                return None
            if w != "fun":
                return None
            j = self.next_code(k + 1)
            name = None
            while j < end and not (self.toks[j].kind == "code" and self.word(j) == "("):
                if self.toks[j].kind in ("code", "string") and (self.word(j)[0].isalnum() or self.word(j)[0] in "_`"):
                    name = self.word(j).strip("`")
                j += 1
            return self.add("METHOD" if classes else "FUNCTION", name, fresh, k, j, classes) if name and j < end else None
        head = [self.word(i) for i in range(fresh, k) if self.toks[i].kind == "code"]
        if self.language == "java":
            j = self.next_code(k + 1)
            if not classes or j >= end or self.toks[j].kind != "code" or self.word(j) != "(" or "=" in head or "." in head[-1:] or any(h in CONTROL for h in head):
                return None
            if w == classes[-1]:
                return self.add("CONSTRUCTOR", w, fresh, k, j, classes)
            return self.add("METHOD", w, fresh, k, j, classes) if [h for h in head if h[0].isalpha() or h in "]>"] else None
        j = self.next_code(k + 1)
        if w == "function":
            if j < end and self.word(j) == "*":
                j = self.next_code(j + 1)
            name, j = self.word(j), self.next_code(j + 1)
            if not (name[0].isalpha() or name[0] in "_$") or classes:
                return None
            if j < end and self.word(j) == "<":
                while j < end and self.word(j) != "(":
                    j += 1
            return self.add("FUNCTION", name, fresh, k, j, classes)
        if not classes:
            return None
        if j < end and self.toks[j].kind == "code" and self.word(j) == "<":
            while j < end and self.word(j) != "(":
                j += 1
        if j >= end or self.toks[j].kind != "code" or self.word(j) != "(" or "=" in head or ":" in head or "." in head[-1:]:
            return None
        return self.add("CONSTRUCTOR" if w == "constructor" else "METHOD", classes[-1] if w == "constructor" else w, fresh, k, j, classes)

    def add(self, kind: str, name: str, fresh: int, k: int, j: int, classes: list[str]) -> int:
        stop = body_end(self.toks, self.text, j)
        start = self.lead(fresh, k)
        text = self.text[start : self.toks[stop - 1].end].rstrip()
        self.found.append(Declaration(kind, name, ".".join(classes) or None, self.package, text))
        return stop


def declarations(text: str, language: str) -> list[Declaration]:
    """Classes, methods, functions and constructors in source order. Files without any give an empty list.

    A class stands with its whole text, in which bodies of nested classes are shortened; nested names are dotted.
    Leading documentation comments and annotations belong to a declaration (Java: ``/**`` comments only).
    """
    return Parser(text.replace("\r\n", "\n"), language).parse()


def code_chunks(text: str, language: str, size: int = 1000, tokens: str = "words") -> list[dict]:
    """Chunks of the declarations: a heading, the package and imports, and the code in a fence, within ``size`` tokens.

    Code above the budget is cut at blank lines, and by tokens where a part is still too large.
    """
    count, split = counter(tokens), splitter(tokens)
    out = []
    for d in declarations(text, language):
        title = d.name
        head = f"## {d.name}" if d.type == "CLASS" else f"### {d.name}"
        context = "\n".join([*([f"package {d.package}"] if d.package else []), *d.imports])
        frame = f"{head}\n```{language}\n{context}\n```"
        budget = max(1, size - count(frame))
        for body in cut_code(d.full_text, budget, count, split):
            inner = f"{context}\n\n{body}" if context else body
            out.append({"type": d.type, "name": title, "class_name": d.class_name, "chunk": f"{head}\n```{language}\n{inner}\n```"})
    return out


def cut_code(text: str, budget: int, count, split) -> list[str]:
    if count(text) <= budget:
        return [text]
    out: list[str] = []
    buffer = ""
    for part in re.split(r"\n[ \t]*\n", text):
        candidate = f"{buffer}\n\n{part}" if buffer else part
        if count(candidate) <= budget:
            buffer = candidate
            continue
        if buffer:
            out.append(buffer)
        buffer = ""
        if count(part) <= budget:
            buffer = part
        else:
            out += split(part, budget)
    return [*out, buffer] if buffer else out
