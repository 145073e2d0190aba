"""Functions paired with their documentation: a string- and comment-aware lexer with brace matching."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.sources.code import Token, body_end, lex, skip_group


def annotation_end(toks: list[Token], text: str, k: int) -> int:
    """Token index behind the annotation at token ``k``: its dotted name and its arguments."""
    k += 1
    while k < len(toks) and toks[k].kind == "code" and text[toks[k].start] in ".:":
        k += 2
    if k < len(toks) and toks[k].kind == "code" and text[toks[k].start] == "(":
        k = skip_group(toks, text, k)
    return k


def declaration(text: str, toks: list[Token] | None = None, k: int = 0) -> tuple[list[Token], int, int]:
    """Of the declaration that begins at token ``k``: the comments before its signature, the offset of its code without
    them, and the token index behind its body. Annotations (with arguments) may stand between comments."""
    toks = lex(text) if toks is None else toks
    comments, code, k = opening(text, toks, k)
    return comments, len(text) if code is None else code, body_end(toks, text, k)


def opening(text: str, toks: list[Token], k: int) -> tuple[list[Token], int | None, int]:
    """Comments and annotations from token ``k`` on: the comments, the offset of the code, the first token behind."""
    comments: list[Token] = []
    code = None
    while k < len(toks):
        t = toks[k]
        if t.kind == "comment":
            comments.append(t)
            k += 1
        elif t.kind == "blank":
            k += 1
        elif t.kind == "code" and text[t.start] == "@" and not text.startswith("@interface", t.start):
            code = t.start if code is None else code
            k = annotation_end(toks, text, k)
        else:
            break
    if k < len(toks) and code is None:
        code = toks[k].start
    return comments, code, k


#: Words that begin no function although brackets and a brace may follow.
KEYWORDS = frozenset("if for while switch catch when return new throw else do try synchronized class interface object enum record assert super this init get set".split())
#: Words that open a class; words in front of a property; what carries a class header or a signature on.
CLASS_WORDS = frozenset("class interface object enum record @interface".split())
PROPERTY = frozenset("val var let const typealias import package".split())
MODIFIERS = frozenset("public private protected internal inline".split())
HEADER = frozenset("{ : , ( < extends implements where permits constructor".split())
SIGNATURE = frozenset("{ = : - , | & where throws default".split())
#: Signs after which, and before which, a line break does not end an expression.
OPEN_AFTER = frozenset("= + - * / % & | ^ < , . : => -> extends implements throws where by else".split())
OPEN_BEFORE = frozenset(". ? : = + - * / % & | ^ < > , ) ] else instanceof".split())
OPEN_BEFORE_KOTLIN = OPEN_BEFORE | frozenset("as in is by".split())


def functions(text: str) -> list[dict]:
    """Functions and methods of a source file: name, enclosing class, code without comments before it, documentation.

    A name followed by a parameter list (type parameters may stand between) is a function if it has a body or ``=``, or
    if it is declared without one in a class or by ``fun`` or ``function``, and the tokens since the last boundary hold
    no ``=`` or control word; so is a name that is given an arrow function or function expression. A boundary is ``;``,
    ``{``, ``}``, the end of a declaration, or the line break behind a property or class header without any of these.
    Nested ones inside bodies of functions are not looked for.
    """
    toks, out, classes = lex(text), [], []
    n = len(toks)

    def at(i: int) -> str:
        return text[toks[i].start : toks[i].end] if 0 <= i < n else ""

    def sign(i: int) -> str:
        """The code at ``i``, with the two-character arrows as one sign."""
        return text[toks[i].start - 1] + ">" if at(i) == ">" and text[toks[i].start - 1 : toks[i].start] in ("=", "-") else at(i)

    def after(i: int) -> int:
        while i < n and toks[i].kind in ("blank", "comment"):
            i += 1
        return i

    def word(i: int) -> bool:
        return i < n and toks[i].kind == "code" and (at(i)[0].isalpha() or at(i)[0] in "_$")

    def breaks(i: int) -> bool:
        return toks[i].kind == "blank" and ("\n" in at(i) or "\r" in at(i))

    def head(k: int) -> list[str]:
        """Code words since the last boundary, without annotations and their arguments."""
        i, words = fresh, []
        while i < k:
            if toks[i].kind == "code":
                if at(i)[0] == "@" and at(i) != "@interface":
                    i = annotation_end(toks, text, i)
                    continue
                if sign(i + 1) != "=>":
                    words.append(sign(i))
            i += 1
        return words

    def parameters(i: int) -> int:
        """Index of the bracket that opens the parameter list at ``i`` or behind type parameters there; else ``n``."""
        i = after(i + 1) if at(i) == "?" else i
        if at(i) == "<":
            level = 0
            while i < n:
                c = sign(i) if toks[i].kind == "code" else ""
                if c in ("(", "[", "{"):
                    i = skip_group(toks, text, i)
                    continue
                if c in (";", "}", ")"):
                    return n
                level += (c == "<") - (c == ">")
                i += 1
                if not level:
                    break
            i = after(i)
        return i if i < n and toks[i].kind == "code" and at(i) == "(" else n

    def value_end(i: int) -> int:
        """Index behind the expression that begins at ``i``."""
        last = "="
        while i < n:
            if breaks(i) and last not in OPEN_AFTER and at(after(i)) not in (OPEN_BEFORE_KOTLIN if kotlin else OPEN_BEFORE):
                return i
            if toks[i].kind == "code":
                if at(i) in (";", "}", ")", "]"):
                    return i
                if at(i) in ("(", "[", "{"):
                    i, last = skip_group(toks, text, i), ")"
                    continue
                last = sign(i)
            elif toks[i].kind == "string":
                last = '"'
            i += 1
        return i

    def finish(i: int) -> tuple[int, bool]:
        """Index behind the declaration whose parameter list ends before ``i``, and whether it has a body."""
        last = ")"
        while i < n:
            if breaks(i) and last not in OPEN_AFTER and at(after(i)) not in SIGNATURE:
                return i, False
            if toks[i].kind == "code":
                c = sign(i)
                if c == "{" and last not in (":", "|", "&", "<", ",", "=>"):
                    return skip_group(toks, text, i), True
                if c in ("(", "[", "{"):
                    i, last = skip_group(toks, text, i), ")"
                    continue
                if c == ";":
                    return i + 1, False
                if c in ("}", ")", "]"):
                    return i, False
                if c == "=" and sign(i + 1) != "=>":
                    return value_end(i + 1), True
                last = c
            i += 1
        return i, False

    def arrow_end(i: int) -> int | None:
        """Index behind the arrow function or function expression that begins at ``i``; None if there is none."""
        i = after(i)
        if at(i) == "async":
            i = after(i + 1)
        if at(i) == "function":
            while i < n and not (toks[i].kind == "code" and at(i) in ("(", ";", "}")):
                i += 1
            end, body = finish(skip_group(toks, text, i)) if at(i) == "(" else (i, False)
            return end if body else None
        i = parameters(i) if at(i) in ("(", "<") else i
        if not (word(i) or at(i) == "("):
            return None
        i = after(skip_group(toks, text, i) if at(i) == "(" else i + 1)
        if at(i) == ":":
            while i < n and sign(i) != "=>" and not (toks[i].kind == "code" and at(i) in (";", "}", ")")):
                i = skip_group(toks, text, i) if toks[i].kind == "code" and at(i) in ("(", "[", "{") else i + 1
            i -= sign(i) == "=>"
        if at(i) != "=" or sign(i + 1) != "=>":
            return None
        i = after(i + 2)
        return skip_group(toks, text, i) if at(i) == "{" else value_end(i)

    def header_end(i: int) -> int:
        """Index of what ends a class header: its brace, or the line break behind a class without a body."""
        last = ""
        while i < n:
            if breaks(i) and last not in OPEN_AFTER:
                j = after(i)
                while at(j)[:1] == "@" or at(j) in MODIFIERS:
                    j = after(annotation_end(toks, text, j) if at(j)[0] == "@" else j + 1)
                if at(after(i)) not in HEADER and (at(j) != "constructor" or at(i).count("\n") > 1):
                    return i
            if toks[i].kind == "code":
                if at(i) in ("{", "}", ";"):
                    return i
                if at(i) in ("(", "["):
                    i, last = skip_group(toks, text, i), ")"
                    continue
                last = sign(i)
            i += 1
        return i

    def ends(k: int) -> bool:
        """Whether the line break at ``k`` ends a member that has neither brace nor semicolon."""
        h = head(k)
        if not h:
            return False
        if at(k + 1).startswith("/**"):
            return True
        if "fun" in h or not ("=" in h or ":" in h or PROPERTY & set(h)):
            return False
        j = after(k)
        if kotlin and at(j) in MODIFIERS:
            j = after(j + 1)
        if kotlin and at(j) in ("get", "set"):
            return False
        return h[-1] not in OPEN_AFTER and at(after(k)) not in (OPEN_BEFORE_KOTLIN if kotlin else OPEN_BEFORE)

    kotlin = any(toks[i].kind == "code" and at(i) in ("fun", "val") and i + 2 < n and toks[i + 1].kind == "blank" and (word(i + 2) or at(i + 2)[0] in "<`") for i in range(n))
    k = fresh = depth = nest = 0
    outer: list[int] = []
    while k < n:
        t = toks[k]
        if breaks(k) and not nest and ends(k):
            fresh = k
        named = word(k) or (t.kind == "string" and at(k)[0] == "`" and head(k)[-1:] == ["fun"])
        if t.kind != "code" and not named:
            k += 1
            continue
        c = at(k)
        if c in ("{", "}", ";"):
            if c == "{":
                outer.append(nest)
                nest = 0
            elif c == "}":
                nest = outer.pop() if outer else 0
            elif classes and depth == classes[-1][1]:
                classes[-1] = (*classes[-1][:2], False)
            depth += (c == "{") - (c == "}")
            while classes and depth < classes[-1][1]:
                classes.pop()
            k += 1
            fresh = k
            continue
        if c in ("(", "[", ")", "]"):
            nest = max(0, nest + (1 if c in ("(", "[") else -1))
            k += 1
            continue
        if c in CLASS_WORDS:
            j = after(k + 1)
            j = after(j + 1) if c == "enum" and at(j) == "class" else j
            if word(j) or (c == "object" and (at(j) == "{" or (at(j) == ":" and head(k)[-1:] and head(k)[-1] in ("=", "companion", "(", ",", "return", "by", "->")))):
                name = at(j) if word(j) and at(j) not in ("extends", "implements") else "Companion" if c == "object" else None
                k = header_end(j)
                if at(k) == "{":
                    depth += 1
                    classes.append((name, depth, c == "enum"))
                    outer.append(nest)
                    nest = 0
                    k += 1
                fresh = k
                continue
        elif c[0] == "@":
            k = annotation_end(toks, text, k)
            continue
        member = bool(classes) and depth == classes[-1][1]
        if c == "=" and not nest and sign(k + 1) != "=>":
            h = head(k)
            end = arrow_end(k + 1) if h and "=" not in h and not kotlin else None
            if end is not None and (member or PROPERTY & set(h)):
                name = next((h[i - 1] for i in range(1, len(h)) if h[i] in (":", "?", "!")), h[-1])
                comments, code, _ = opening(text, toks, fresh)
                out.append({"name": name, "class_name": classes[-1][0] if classes else None, "code": text[code : toks[end - 1].end].strip(), "doc": description(comments, text, name, toks=toks, end=end)})
                k = fresh = end
                continue
        if named and not nest:
            h = head(k)
            p = parameters(after(k + 1))
            known = c not in KEYWORDS or "fun" in h[-1:] or (h[-1:] == ["."] and "fun" in h) or (member and not kotlin)
            typed = "fun" in h or c == "constructor" if kotlin else "." not in h[-1:]
            if p < n and known and typed and not (member and classes[-1][2]) and "=" not in h and not any(w in ("new", "return", "throw") or w in PROPERTY for w in h):
                end, body = finish(skip_group(toks, text, p))
                if body or "fun" in h or "function" in h or (member and not kotlin and c not in ("new", "constructor")):
                    comments, code, _ = opening(text, toks, fresh)
                    name = c.strip("`")
                    out.append({"name": name, "class_name": classes[-1][0] if classes else None, "code": text[code : toks[end - 1].end].strip(), "doc": description(comments, text, name, toks=toks, end=end)})
                    k = fresh = end
                    continue
                if kotlin or "{" not in text[toks[p].start : toks[end - 1].end]:
                    k = fresh = end
                    continue
        k += 1
    return out


#: Marks of notices that are not documentation of a function.
NOTICE = re.compile(
    r"copyright|©|\(c\)\s*\d{4}|licen[sc]ed?\b|spdx|all rights reserved|permission is hereby|apache software|gnu general|warranty"
    r"|generated (?:by|code|from|automatically|method|stub)|auto-?generated|do not (?:edit|modify)|(?:method|function|constructor) stub|@generated|noinspection|eslint|tslint|ktlint|prettier-ignore|istanbul|@ts-",
    re.IGNORECASE,
)
PLACEHOLDER = re.compile(r"(?:todo|fixme|xxx|hack|tbd|tbc|wip|n/?a|none|nothing|placeholder|description|documentation|document (?:this|me)|javadoc|kdoc|jsdoc|comment|lorem ipsum|fill in|to be (?:done|defined|documented)|add (?:description|documentation|doc|comment)s?(?: here)?|missing|undocumented|see above|see below)\b", re.IGNORECASE)
TAG = re.compile(r"^\s*[@\\][A-Za-z]\w*")
INLINE = re.compile(r"\{@(?:inheritDoc|link|code|value|linkplain|literal|see)\b[^{}]*\}", re.IGNORECASE)
HTML = re.compile(r"</?[A-Za-z][^<>]*>|&[a-z]+;")
CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:val|var|let|const|return|if|for|while|import|package|public|private|protected|static|fun|function|final|int|void|new|throw|await|this\.)\b.*[=(;{]|^\s*[\w.$]+\s*\([^)]*\)\s*;?\s*$|^\s*[\w.$\[\]]+\s*[-+*/]?=\s*\S|=>|^\s*@\w+(?:\([^)]*\))?\s*$|&&|\|\|")
NO_SPACES = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯฀-๿]")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")

#: Words that say nothing of their own in a description.
EMPTY_WORDS = frozenset(
    """a an the this that these those it its of to for from in on at by with and or as is are be was if so no not given
    get gets getter set sets setter return returns returned value values function functions method methods constructor class object objects instance
    param parameter parameters arg args argument arguments result results does do some any all new default main helper util utility
    simple implementation implements override overrides called call calls used use uses using""".split()
)


def plain(comment: str) -> str:
    """Text of a comment without its markers, leading stars and decoration."""
    body = comment
    if body.startswith("//"):
        lines = re.split(r"\r\n|\r|\n", body)
        return "\n".join(re.sub(r"^\s*/{2,}[!/<]*", "", x).strip() for x in lines)
    body = re.sub(r"^/\*+!?", "", body)
    body = re.sub(r"\*+/$", "", body)
    return "\n".join(re.sub(r"^\s*\*+(?!\w)", "", x).strip() for x in re.split(r"\r\n|\r|\n", body))


def stem(word: str) -> str:
    w = word.lower()
    for end in ("ings", "ing", "ies", "ers", "ed", "es", "er", "or", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def prose(text: str) -> str:
    """Sentences of a comment: no tag lines and what follows them, fenced or commented-out code, separators, HTML."""
    keep, fenced, tagged = [], False, False
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith(("```", "~~~", "<pre", "</pre")):
            fenced = not fenced and not (s.startswith("<pre") and "</pre" in s)
            continue
        if fenced:
            continue
        if TAG.match(s):
            tagged = True
            continue
        if not s:
            tagged = False
            keep.append("")
            continue
        if tagged or not any(c.isalpha() for c in s):
            continue
        s = HTML.sub(" ", INLINE.sub(" ", s)).strip()
        if CODE_LINE.search(s) and not s.endswith((".", "。")):
            continue
        if PLACEHOLDER.match(s) and (len(WORD.findall(s)) <= 4 or re.match(r"(?i)todo|fixme|xxx|hack", s)):
            continue
        keep.append(s)
    return "\n".join(keep).strip()


def telling(text: str, names: list[str]) -> int:
    """Number of distinct words that say more than the names: not part of them, no tag, no empty word.

    A full sentence in a script without spaces counts as four."""
    known = {stem(p) for n in names if n for p in CAMEL.findall(n)} | {n.lower() for n in names if n}
    dense = NO_SPACES.findall(text)
    if len(dense) >= 6:
        return 4 + len(dense)
    words = {w.lower() for w in WORD.findall(text)}
    return len({w for w in words if stem(w) not in known and w not in known and w not in EMPTY_WORDS and len(w) > 1})


def blocks(comments: list[Token], text: str) -> list[str]:
    """Comments as written, with line comments on neighbouring lines joined to one block."""
    out: list[str] = []
    last = None
    for t in comments:
        body = text[t.start : t.end]
        if body.startswith("//") and last is not None and out and out[-1].startswith("//") and text[last:t.start].count("\n") + (text[last:t.start].count("\r") if "\n" not in text[last:t.start] else 0) <= 1:
            out[-1] += "\n" + body
        else:
            out.append(body)
        last = t.end
    return out


def signature_names(text: str, toks: list[Token], start: int, end: int) -> list[str]:
    """Words of the code from offset ``start`` up to the body: a brace or ``=`` outside brackets, or token ``end``."""
    k = bisect_left(toks, start, key=lambda t: t.start)
    names: list[str] = []
    depth = 0
    while k < end:
        t = toks[k]
        if t.kind == "code":
            c = text[t.start]
            if not depth and (c == "{" or (c == "=" and not text.startswith("=>", t.start))):
                break
            depth += (c in "([{") - (c in ")]}")
            names += re.findall(r"[A-Za-z_]\w*", text[t.start : t.end])
        k += 1
    return names


def description(comments: list[Token], text: str, name: str, class_name: str | None = None, toks: list[Token] | None = None, end: int | None = None) -> str | None:
    """The documentation of a declaration that ends before token ``end``, or None if it is trivial; the last non-trivial
    comment block stands."""
    toks = lex(text) if toks is None else toks
    params = signature_names(text, toks, comments[-1].end, len(toks) if end is None else end) if comments else []
    names = [name, class_name or "", *params]
    for body in reversed(blocks(comments, text)):
        raw = plain(body)
        if NOTICE.search(raw):
            lines = [x for x in raw.split("\n") if not NOTICE.search(x)]
            raw = "\n".join(lines) if not re.search(r"(?i)copyright|licen[sc]e|spdx|generated|stub", raw) else ""
        said = prose(raw)
        if said and telling(said, names) >= 4:
            return said
    return None


def declaration_pairs(declarations: DataFrame) -> DataFrame:
    """``(decl_id, declaration_name, class_name, lang, code, description)`` of the truly documented METHOD and FUNCTION rows.

    The description is the text of the comment before the signature (annotations may stand between) without tags,
    code and decoration. Rows repeated with the same ``decl_id`` give one row; null, empty or comment-free texts give
    none (filtered out before Python sees them); null names only mean that no words are excused. Comments and braces in
    strings, and comments inside the body, never count. Nothing but the removal of repeated rows shuffles.
    """
    src = declarations.select("decl_id", "declaration_name", "class_name", "lang", "full_text").where(
        F.col("declaration_type").isin("METHOD", "FUNCTION") & (F.contains("full_text", F.lit("//")) | F.contains("full_text", F.lit("/*")))
    )

    def run(frames):
        for pdf in frames:
            rows = []
            for did, name, cls, lang, text in pdf.itertuples(index=False):
                toks = lex(text)
                comments, code, end = declaration(text, toks)
                doc = description(comments, text, name or "", cls, toks, end) if comments else None
                if doc:
                    rows.append((did, name, cls, lang, text[code : toks[end - 1].end], doc))
            yield pd.DataFrame(rows, columns=["decl_id", "declaration_name", "class_name", "lang", "code", "description"])

    got = src.mapInPandas(run, "decl_id bigint, declaration_name string, class_name string, lang string, code string, description string")
    return got.dropDuplicates(["decl_id"])


def file_pairs(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, name, class_name, code, description)`` for every documented function in whole source files.

    Functions with empty or trivial documentation are dropped; null and empty texts give no rows.
    """
    def run(frames):
        for pdf in frames:
            rows = [(i, f["name"], f["class_name"], f["code"], f["doc"]) for i, t in pdf.itertuples(index=False) for f in functions(t) if f["doc"]]
            yield pd.DataFrame(rows, columns=["id", "name", "class_name", "code", "description"])

    src = files.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return src.mapInPandas(run, "id string, name string, class_name string, code string, description string")
