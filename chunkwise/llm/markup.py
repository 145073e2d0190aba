"""Markup residue: token streams, union-free wrappers per host, and clean text that keeps structure."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.session import persist_table

#: Element names of HTML and of the tags used in wiki text.
TAGS = frozenset(
    """a abbr acronym address area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption center
    cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter
    nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small
    source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr
    ref references nowiki gallery syntaxhighlight math includeonly noinclude onlyinclude poem""".split()
)
#: Attributes that may stand without a value.
BARE = frozenset("allowfullscreen async autofocus autoplay checked compact controls default defer disabled download hidden loop multiple muted nohref noshade novalidate nowrap open readonly required reversed selected".split())
#: LaTeX commands that stand without an argument in braces.
LATEX_BARE = frozenset(
    """item ldots dots LaTeX TeX newline noindent par maketitle tableofcontents hline quad qquad centering newpage clearpage pagebreak linebreak
    bigskip medskip smallskip textellipsis itshape bfseries ttfamily small large Large footnotesize indent appendix today toprule midrule
    bottomrule alpha beta gamma delta epsilon lambda mu pi sigma omega theta phi sum prod int infty times cdot le ge leq geq neq approx pm to
    rightarrow leftarrow Rightarrow""".split()
)

ATTRS = r"(?:\s+[A-Za-z_:@][\w:.\-]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)*"
TAG = re.compile(rf"<(/?)([A-Za-z][A-Za-z0-9]*)({ATTRS})\s*(/?)>")
ATTR = re.compile(r"([A-Za-z_:@][\w:.\-]*)(\s*=)?")
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
DOCTYPE = re.compile(r"<!DOCTYPE[^<>]*>|<!\[CDATA\[|\]\]>", re.I)
ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
FENCE = re.compile(r"(`{3,}|~{3,})[^\n`]*\n(?:.*?\n)??[ \t]*\1[`~]*[ \t]*(?=\n|\Z)|(`{3,}|~{3,})[^\n]*\n.*\Z", re.S)
INLINE = re.compile(r"(`+)(?!`)(?:(?!\n\s*\n).)+?(?<!`)\1(?!`)", re.S)
LATEX_QUOTE = re.compile(r"``(?=[^\s`])[^`\n]{1,300}?(?<=\S)''")
MATH = re.compile(r"\$\$.+?\$\$|\$(?=[^\s$])(?:[^$\n\\]|\\.)*?(?<=[^\s\\])\$(?!\d)", re.S)
WIKI_LINK = re.compile(r"\[\[(?=[^\W\d_:#]|[:#])([^\[\]\n|]+)((?:\|[^\[\]\n|]*)*)\]\]")
TEMPLATE = re.compile(r"\{\{(?=[^\W\d_#:])([^{}|\n]+?)\s*((?:\|[^{}]*)+)\}\}")
WIKI_QUOTE = re.compile(r"('{2,5})(?=[^\s'])([^'\n]*(?:'[^'\n]+)*?)(?<=[^\s'])('{2,5})(?!')")
WIKI_HEAD = re.compile(r"(={2,6})[ \t]*(?=[^\s=])(.*?)[ \t]*\1[ \t]*(?=\n|\r|\Z)")
WIKI_TABLE = re.compile(r"\{\|[^\n]*|\|\}[ \t]*(?=\n|\r|\Z)|\|-[ \t]*(?=\n|\r|\Z)|\|\+[^\n]*")
EXT_LINK = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)(?:[ \t]+([^\]\n]+))?\](?!\()")
ENVIRONMENT = re.compile(r"\\(begin|end)\s*\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
COMMAND = re.compile(r"\\([A-Za-z]{2,})\*?((?:\s*\[[^\[\]\n]*\])*(?:\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})+|(?:\s*\[[^\[\]\n]*\])*(?=\{)|)")
TEX_MATH = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
MD_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)")
MD_LINK = re.compile(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\((<?(?:https?:|ftp:|mailto:|tel:|#|/|\.{1,2}/|\?|[\w\-%~]+(?:[./#?][\w\-%~./#?=&]*))[^()\s]*(?:\([^()\s]*\)[^()\s]*)*>?)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)")
MD_REF = re.compile(r"\[([^\[\]\n]*[^\W\d_][^\[\]\n]*)\][ ]?\[([^\[\]\n]*)\]")
MD_DEF = re.compile(r"\[(?!\^)([^\[\]\n]+)\]:[ \t]+<?(?:https?:|ftp:|mailto:|#|/|\.{1,2}/|[\w\-]+[./])\S*(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*(?=\n|\r|\Z)")
STRONG = re.compile(r"\*\*(?=[^\s*/.,;:)])([^*\n]+(?:\*[^*\n]+\*[^*\n]*)*)(?<=[^\s*(])\*\*(?![\w*/])")
BOTH = re.compile(r"\*\*\*(?=[^\s*/.,;:)])([^*\n]+)(?<=[^\s*(])\*\*\*(?![\w*/])")
STRONG_ = re.compile(r"__(?=[^\s_])([^_\n]+(?:_[^_\n]+)*?)(?<=[^\s_])__(?!\w)")
EMPH = re.compile(r"\*(?=[^\W_]|[\"'(“\[`])([^*\n]+?)(?<=[^\s*(])\*(?![\w*/])")
EMPH_ = re.compile(r"_(?=[^\W_])([^_\n]*?[^\W_][ ][^_\n]*?)(?<=[^\s_])_(?!\w)")
STRIKE = re.compile(r"~~(?=[^\s~])([^~\n]+)(?<=[^\s~])~~(?!~)")
SETEXT = re.compile(r"^(?![ \t]*(?:[-*+>|#]|\d+[.)])[ \t]?)(?=[^\n]*\w)([^\n|]*[^\s|][^\n|]*)\r?\n(={3,}|-{3,})[ \t]*(?=\r?\n|\Z)", re.M)

#: Where a construct can begin; everything between two of these places is text.
PLACE = re.compile(
    r"<(?=[A-Za-z/!])|&(?=[#A-Za-z])|!\[|\[(?=[^\s\]])|\{(?=[{|])|'{2,5}(?=[^\s'])|^={2,6}(?!=)|^\|[-}+]|\\(?=[A-Za-z(\[])|`|\*{1,3}(?=[^\s*])|(?<![^\W_])_{1,2}(?=[^\s_])|~{2,}|\$",
    re.M,
)
LETTER = re.compile(r"[^\W_]")


class Token:
    """A piece of the stream: ``kind`` is ``text``, ``keep`` (fence, code, formula) or the markup language; ``shape``
    names the construct; ``out`` is what stands for it in clean text."""

    __slots__ = ("kind", "shape", "start", "end", "out")

    def __init__(self, kind: str, shape: str, start: int, end: int, out: str = ""):
        self.kind, self.shape, self.start, self.end, self.out = kind, shape, start, end, out


#: What block elements become.
OPEN = {"p": "\n\n", "div": "\n", "br": "\n", "hr": "\n\n---\n\n", "li": "\n- ", "ul": "\n", "ol": "\n", "table": "\n", "tr": "\n| ", "blockquote": "\n> ", "code": "`", "kbd": "`", "samp": "`", "tt": "`", "pre": "\n```\n", "source": "\n```\n", "syntaxhighlight": "\n```\n", "math": "$", "dt": "\n", "dd": "\n- ", "section": "\n", "article": "\n", "header": "\n", "footer": "\n"}
CLOSE = {"p": "\n\n", "div": "\n", "ul": "\n", "ol": "\n", "table": "\n\n", "td": " | ", "th": " | ", "blockquote": "\n\n", "code": "`", "kbd": "`", "samp": "`", "tt": "`", "pre": "\n```\n", "source": "\n```\n", "syntaxhighlight": "\n```\n", "math": "$", "section": "\n"}
DROPPED = ("script", "style", "ref", "gallery")


def tag(text: str, at: int) -> Token | None:
    m = TAG.match(text, at)
    if not m or m.group(2).lower() not in TAGS:
        return None
    closing, name, attrs = m.group(1), m.group(2), m.group(3)
    for a in ATTR.finditer(re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+)", "=", attrs)):
        if not a.group(2) and a.group(1).lower() not in BARE:
            return None
    low = name.lower()
    if at and (text[at - 1].isalnum() or text[at - 1] in "_?") and name[0].isupper() and not attrs and not closing and f"</{name}" not in text[at:]:
        return None  # a type parameter
    if low in DROPPED and not closing and not m.group(4):
        end = re.compile(rf"</{low}\s*>", re.I).search(text, m.end())
        if end:
            return Token("html", f"<{low}>", at, end.end())
    head = re.fullmatch(r"h([1-6])", low)
    if head:
        out = "\n\n" if closing else "\n\n" + "#" * int(head.group(1)) + " "
    elif low == "img":
        alt = re.search(r"alt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", attrs, re.I)
        out = (alt.group(1) or alt.group(2) or "") if alt else ""
    else:
        out = (CLOSE if closing else OPEN).get(low, "")
    return Token("html", f"<{closing}{low}>", at, m.end(), out)


def latex(text: str, at: int) -> Token | None:
    if at and (text[at - 1].isalnum() or text[at - 1] in ":_\\.%"):
        return None
    m = TEX_MATH.match(text, at)
    if m:
        return Token("latex", "\\(", at, m.end(), "$" + (m.group(1) or m.group(2)).strip() + "$")
    m = ENVIRONMENT.match(text, at)
    if m:
        math = m.group(2).rstrip("*") in ("equation", "align", "displaymath", "math", "gather", "eqnarray")
        code = m.group(2).rstrip("*") in ("verbatim", "lstlisting", "minted")
        return Token("latex", f"\\{m.group(1)}", at, m.end(), "$$" if math else "\n```\n" if code else "")
    m = COMMAND.match(text, at)
    if not m:
        return None
    name, args = m.group(1), m.group(2)
    if not args and text[m.end() : m.end() + 1] != "{" and name not in LATEX_BARE:
        return None
    if not args and text[m.end() : m.end() + 1] in "\\_:" and text[m.end() : m.end() + 1]:
        return None  # a path
    inner = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", args)
    body = clean(inner[-1]) if inner else ""
    levels = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    if name in levels:
        out = "\n\n" + "#" * levels[name] + f" {body}\n\n"
    elif name == "item":
        out = "\n- " + body
    elif name in ("label", "index", "cite", "ref", "pageref", "citep", "citet", "bibliography", "usepackage", "documentclass", "vspace", "hspace", "eqref"):
        out = ""
    elif name == "texttt" or name == "verb":
        out = f"`{inner[-1] if inner else ''}`"
    elif name in ("ldots", "dots", "textellipsis"):
        out = "…"
    elif name in ("frac", "sqrt", "sum", "prod", "int") or (name in LATEX_BARE and not args and name.islower() and len(name) > 1 and name in ("alpha", "beta", "gamma", "delta", "epsilon", "lambda", "mu", "pi", "sigma", "omega", "theta", "phi", "infty", "times", "cdot", "le", "ge", "leq", "geq", "neq", "approx", "pm", "to")):
        out = f"${m.group()}$"
    elif name == "footnote":
        out = f" ({body})"
    elif name == "href":
        out = body
    else:
        out = body if inner else ("\n" if name in ("newline", "linebreak", "par") else "")
    return Token("latex", f"\\{name}", at, m.end(), out)


def bracket(text: str, at: int) -> Token | None:
    before = text[at - 1] if at else "\n"
    m = WIKI_LINK.match(text, at)
    if m and not (before.isalnum() or before in "_)]\"") and not re.fullmatch(r"[\s\d,.;:]*", m.group(1)):
        target, label = m.group(1), m.group(2).split("|")[-1].strip()
        out = "" if re.match(r"(?i)category|kategorie|catégorie", target) else label or ("" if re.match(r"(?i)(?:file|image|datei|bild|fichier):", target) else target.lstrip(":"))
        return Token("wiki", "[[", at, m.end(), out)
    m = EXT_LINK.match(text, at)
    if m:
        return Token("wiki", "[http", at, m.end(), m.group(2) or m.group(1))
    if before.isalnum() or before in "_)]":
        return None
    m = MD_LINK.match(text, at)
    if m:
        return Token("markdown", "](", at, m.end(), clean(m.group(1)))
    if before in "\n\r" or not text[text.rfind("\n", 0, at) + 1 : at].strip():
        m = MD_DEF.match(text, at)
        if m:
            return Token("markdown", "]:", at, m.end())
    m = MD_REF.match(text, at)
    if m and (not m.group(2) or re.fullmatch(r"[\w\-. ]+", m.group(2))):
        return Token("markdown", "][", at, m.end(), m.group(1))
    return None


def star(text: str, at: int) -> Token | None:
    c = text[at]
    before = text[at - 1] if at else " "
    if LETTER.match(before) or before in "/\\" + c:
        return None
    if text.startswith("***", at):
        m = BOTH.match(text, at)
        return Token("markdown", "***", at, m.end(), clean(m.group(1))) if m and LETTER.search(m.group(1)) else None
    m = (STRONG if c == "*" else STRONG_).match(text, at)
    if m and LETTER.search(m.group(1)) and (c == "*" or not re.fullmatch(r"\w+", m.group(1))):
        return Token("markdown", c * 2, at, m.end(), clean(m.group(1)))
    if text[at : at + 2] == c * 2:
        return None
    m = (EMPH if c == "*" else EMPH_).match(text, at)
    if m and LETTER.search(m.group(1)):
        return Token("markdown", c, at, m.end(), clean(m.group(1)))
    return None


def construct(text: str, at: int) -> Token | None:
    """The construct that begins at ``at``, if it is one: markup, or a fence, code or formula that is kept."""
    c = text[at]
    if c == "<":
        m = COMMENT.match(text, at)
        if m:
            return Token("html", "<!--", at, m.end())
        m = DOCTYPE.match(text, at)
        return Token("html", "<!", at, m.end()) if m else tag(text, at)
    if c == "&":
        m = ENTITY.match(text, at)
        if m and (m.group(1)[0] == "#" or m.group(1) + ";" in html5):
            return Token("html", "&", at, m.end(), html.unescape(m.group()).replace("\xa0", " "))
        return None
    if c == "[":
        return bracket(text, at)
    if c == "!":
        m = MD_IMAGE.match(text, at)
        return Token("markdown", "![", at, m.end(), m.group(1)) if m else None
    if c == "{":
        m = TEMPLATE.match(text, at)
        if m:
            parts = [p for p in m.group(2).split("|")[1:] if "=" not in p]
            return Token("wiki", "{{", at, m.end(), " ".join(p.strip() for p in parts))
        m = WIKI_TABLE.match(text, at) if not text[text.rfind("\n", 0, at) + 1 : at].strip() else None
        return Token("wiki", "{|", at, m.end()) if m else None
    if c == "|":
        m = WIKI_TABLE.match(text, at)
        return Token("wiki", m.group()[:2], at, m.end()) if m else None
    if c == "'":
        m = WIKI_QUOTE.match(text, at)
        if m and LETTER.search(m.group(2)) and len(m.group(1)) == len(m.group(3)) and not (at and (text[at - 1].isalnum() or text[at - 1] in "'=(,")):
            return Token("wiki", "''", at, m.end(), clean(m.group(2)))
        return None
    if c == "=":
        m = WIKI_HEAD.match(text, at)
        return Token("wiki", "==", at, m.end(), "#" * len(m.group(1)) + " " + clean(m.group(2))) if m else None
    if c == "\\":
        return latex(text, at)
    if c == "`" or text.startswith("~~~", at):
        m = FENCE.match(text, at) if not text[text.rfind("\n", 0, at) + 1 : at].strip() else None
        if m and text[at : at + 3] in ("```", "~~~"):
            return Token("keep", "fence", at, m.end(), m.group())
        if c == "~":
            return None
        m, q = INLINE.match(text, at), LATEX_QUOTE.match(text, at)
        if q and (not m or q.end() <= m.end()):
            return Token("latex", "``", at, q.end(), "“" + q.group()[2:-2] + "”")
        return Token("keep", "code", at, m.end(), m.group()) if m else None
    if c == "$":
        m = MATH.match(text, at)
        return Token("keep", "formula", at, m.end(), m.group()) if m else None
    if c in "*_":
        return star(text, at)
    if c == "~":
        m = STRIKE.match(text, at)
        return Token("markdown", "~~", at, m.end(), m.group(1)) if m else None
    return None


def stream(text: str) -> list[Token]:
    """The token stream of a text; joined, the tokens cover it without gaps."""
    under = {}
    if "---" in text or "===" in text:
        for m in SETEXT.finditer(text):
            under[m.start()] = m
    out: list[Token] = []
    pos = done = 0
    n = len(text)
    spots = sorted(under)
    while pos < n:
        m = PLACE.search(text, pos)
        at = m.start() if m else n
        while spots and spots[0] < pos:
            spots.pop(0)
        if spots and spots[0] <= at:
            u = under[spots.pop(0)]
            inner = any(out and t.kind == "keep" and t.end > u.start() for t in out[-1:])
            if not inner:
                if u.start() > done:
                    out.append(Token("text", "T", done, u.start(), text[done : u.start()]))
                level = "# " if u.group(2)[0] == "=" else "## "
                out.append(Token("markdown", "setext", u.start(), u.end(), level + clean(u.group(1).strip())))
                pos = done = u.end()
                continue
        if not m:
            break
        t = construct(text, at)
        if t is None:
            pos = m.end()
            continue
        if at > done:
            out.append(Token("text", "T", done, at, text[done:at]))
        out.append(t)
        pos = done = max(t.end, at + 1)
    if done < n:
        out.append(Token("text", "T", done, n, text[done:]))
    return out


def clean(text: str) -> str:
    """Clean text of a token stream: headings as ``#`` lines, lists as ``-``, code, fences, formulas and pipe tables stay."""
    toks = stream(text)
    if all(t.kind in ("text", "keep") for t in toks):
        return text
    out = re.sub(r"[ \t]+\n", "\n", "".join(t.out for t in toks))
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n")


def collapse(shapes: list[str]) -> list[tuple]:
    """Tandem repeats of groups of tokens, however wide, become one repeated group, narrow groups first.

    Items are ``(item, repeated, optional)``; the item of a group is a tuple of items."""
    seq: list = [(s, False, False) for s in shapes]
    tried: set[int] = set()
    while True:
        code: dict = {}
        ids = np.array([code.setdefault(x, len(code)) for x in seq], np.int64)
        last: dict[int, int] = {}
        widths = set()
        for i, x in enumerate(ids.tolist()):
            if x in last:
                widths.add(i - last[x])
            last[x] = i
        found = 0
        for width in sorted(w for w in widths - tried if 2 * w <= len(ids)):
            same = np.flatnonzero(np.diff(np.concatenate(([0], (ids[:-width] == ids[width:]).view(np.int8), [0]))))
            if (same[1::2] - same[::2] >= width).any():
                found = width
                break
            tried.add(width)
        if not found:
            return seq
        tried = {w for w in tried if w < found}
        out: list = []
        i = 0
        while i < len(seq):
            group = seq[i : i + found]
            j = i + found
            while len(group) == found and seq[j : j + found] == group:
                j += found
            if j > i + found:
                out.append((tuple(group), True, False) if found > 1 else (group[0][0], True, group[0][2]))
                i = j
            else:
                out.append(seq[i])
                i += 1
        seq = out
        tried.add(found)


#: Bits of the table that one alignment holds at most; larger ones are halved until their parts fit.
TABLE_BITS = 1 << 28


def suffix_rows(a: list, b: list) -> list[int]:
    """Row ``r`` has, at bit ``c``, 0 where the longest common subsequence of the last ``r`` of ``a`` with the last
    ``c + 1`` of ``b`` is longer by one than with the last ``c``."""
    where: dict = {}
    for c, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << c
    full = (1 << len(b)) - 1
    rows = [full]
    for x in reversed(a):
        v = rows[-1]
        u = v & where.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def last_row(a: list, b: list) -> list[int]:
    """Length of the longest common subsequence of ``a`` with the last ``c`` of ``b``, for each ``c``."""
    where: dict = {}
    for c, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << c
    v = full = (1 << len(b)) - 1
    for x in reversed(a):
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    out = [0]
    for c in reversed(format(v, f"0{len(b)}b") if b else ""):
        out.append(out[-1] + (c == "0"))
    return out


def matches(a: list, b: list, bits: int = TABLE_BITS) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Bits hold the table; one above ``bits`` is cut where the halves fit best."""
    n, m = len(a), len(b)
    if n > 1 and n * m > bits:
        h = n // 2
        front, back = last_row(a[:h][::-1], b[::-1]), last_row(a[h:], b)
        at = max(range(m + 1), key=lambda j: front[j] + back[m - j])
        return [*matches(a[:h], b[:at], bits), *((i + h, j + at) for i, j in matches(a[h:], b[at:], bits))]
    rows = suffix_rows(a, b)
    out = []
    i = j = 0
    while i < n and j < m:
        here, below = rows[n - i], rows[n - i - 1]
        mask = (1 << (m - j)) - 1
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif not here >> (m - j - 1) & 1 or (here & mask).bit_count() == (below & mask).bit_count():
            i += 1
        else:
            j += 1
    return out


def one(items: list[tuple], rep: bool, opt: bool) -> tuple:
    """Several items as one group, a single one as itself."""
    if len(items) == 1:
        x, r, o = items[0]
        return (x, r or rep, o or opt)
    return (tuple(items), rep, opt)


def resolve(out: list[tuple], span: list[tuple]) -> None:
    """Put a mismatched ``span`` behind ``out``: if it repeats what stands there, that becomes a repeated group, else the
    span becomes an optional one."""
    if not span:
        return
    n = len(span)
    tail = out[-n:]
    if [t[0] for t in tail] == [x[0] for x in span]:
        out[-n:] = [one([(t[0], t[1] or x[1], t[2] or x[2]) for t, x in zip(tail, span)], True, False)]
    elif n == 1 and out and out[-1][1] and out[-1][0] == span[0][0]:
        out[-1] = (out[-1][0], True, out[-1][2] or span[0][2])
    elif all(x[2] for x in span):
        out += span
    else:
        out.append(one(span, False, True))


def align(wrapper: list[tuple], sample: list[tuple]) -> list[tuple]:
    """Union-free wrapper of two token expressions: matching items stay, mismatches become repeated or optional groups.

    The longest common subsequence of the items decides what matches; repetition on either side is kept. Text is one
    kind of token whatever it says, so mismatched texts are slots from the outset. What either expression matches, the
    result matches.
    """
    out: list[tuple] = []
    i = j = 0
    for x, y in [*matches([w[0] for w in wrapper], [s[0] for s in sample]), (len(wrapper), len(sample))]:
        resolve(out, wrapper[i:x])
        resolve(out, sample[j:y])
        if x < len(wrapper):
            out.append((wrapper[x][0], wrapper[x][1] or sample[y][1], wrapper[x][2] or sample[y][2]))
        i, j = x + 1, y + 1
    return general(out)


def leaves(x) -> list[str]:
    return [leaf for y in x for leaf in leaves(y[0])] if isinstance(x, tuple) else [x]


def general(wrapper: list[tuple]) -> list[tuple]:
    """A wrapper that has come to hold the same tokens over and over, more than twice as many as there are kinds of them,
    gives up their order: the stretch between the first and the last that recurs becomes one repeated group of optional
    tokens. So wrappers stay about as long as the vocabulary of a host, however many streams they match."""
    each = [leaves(w[0]) for w in wrapper]
    count: dict[str, int] = {}
    for few in each:
        for x in few:
            count[x] = count.get(x, 0) + 1
    if sum(map(len, each)) <= 2 * len(count) + 8:
        return wrapper
    at = [i for i, few in enumerate(each) if any(count[x] > 1 for x in few)]
    lo, hi = at[0], at[-1] + 1
    kinds = list(dict.fromkeys(x for few in each[lo:hi] for x in few))
    return [*wrapper[:lo], (tuple((x, False, True) for x in kinds), True, True), *wrapper[hi:]]


def expression(wrapper: list[tuple]) -> str:
    """The wrapper as written: ``?`` optional, ``+`` repeated, ``*`` both; kinds of markup are left out."""
    def item(w) -> str:
        x, rep, opt = w
        return ("(" + " ".join(map(item, x)) + ")" if isinstance(x, tuple) else x.split(":", 1)[1] if x.split(":", 1)[0] in KINDS else x) + ("*" if rep and opt else "+" if rep else "?" if opt else "")

    return " ".join(map(item, wrapper))


def infer(streams: list[list[str]]) -> list[tuple]:
    """Wrapper of several token streams by aligning one after the other, shortest first."""
    return fold([collapse(s) for s in streams])


def fold(wrappers: list[list[tuple]]) -> list[tuple]:
    """Wrapper of several wrappers by aligning one after the other, shortest first."""
    ordered = sorted(wrappers, key=lambda s: (len(s), repr(s)))
    if not ordered:
        return []
    wrapper = ordered[0]
    for s in ordered[1:]:
        if s != wrapper:
            wrapper = align(wrapper, s)
    return wrapper


class Reader:
    """Reads token streams through a wrapper, as an automaton over the places of its tokens kept in the bits of numbers."""

    def __init__(self, wrapper: list[tuple]):
        self.follow: list[int] = []
        self.places: dict[str, int] = {}
        self.empty, self.first, self.last = self._sequence(wrapper)

    def _sequence(self, items) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for x, rep, opt in items:
            if isinstance(x, tuple):
                e, f, z = self._sequence(x)
            else:
                e, f = False, 1 << len(self.follow)
                z = f
                self.places[x] = self.places.get(x, 0) | f
                self.follow.append(0)
            if rep:
                self._link(z, f)
            self._link(last, f)
            first |= f if empty else 0
            last = z | (last if e or opt else 0)
            empty = empty and (e or opt)
        return empty, first, last

    def _link(self, ends: int, begins: int) -> None:
        while ends:
            low = ends & -ends
            self.follow[low.bit_length() - 1] |= begins
            ends ^= low

    def markup(self, stream: list[str]) -> list[int] | None:
        """Places in the stream that items of markup match: all others fill text slots or are kept. None if the wrapper
        does not match the stream."""
        state = -1
        out = []
        for i, x in enumerate(stream):
            may = self.first if state < 0 else 0
            s = max(state, 0)
            while s:
                low = s & -s
                may |= self.follow[low.bit_length() - 1]
                s ^= low
            state = may & self.places.get(x, 0)
            if not state:
                return None
            if x.split(":", 1)[0] in KINDS:
                out.append(i)
        return out if (self.empty if state < 0 else state & self.last) else None


def frozen(x):
    """Lists from JSON as tuples."""
    return tuple(map(frozen, x)) if isinstance(x, list) else x


def host(source):
    """Host of a URL, or the first two folders of a path."""
    return F.coalesce(F.nullif(F.regexp_extract(source, r"^[a-z]+://([^/?#]+)", 1), F.lit("")), F.nullif(F.regexp_extract(source, r"^(/[^/]+/[^/]+)/", 1), F.lit("")), F.lit(""))


#: Texts without any of these signs hold no markup and never reach Python.
HINT = r"(?m)[<&\[{'=\\`*_~]|--|^\|[-}+]"


#: Languages whose constructs are markup.
KINDS = frozenset(("html", "wiki", "latex", "markdown"))
#: Parts into which the rows of one stream of a host are cut where they meet its reading; streams a task reads at once.
SALT, READ_ROWS = 16, 10_000


def items(toks: list[Token]) -> list[str]:
    """The stream as compared: markup by language and construct, text and what is kept by kind."""
    return [f"{t.kind}:{t.shape}" if t.kind in KINDS else t.shape for t in toks]


def examined(chunks: DataFrame, pieces: bool = False) -> DataFrame:
    """``(chunk_id, field, host, sid, stream)`` of content (field 0) and heading title (1) of the chunks that may hold
    markup, as a table in the shared folder; a null field has no row.

    ``sid`` names the token stream; the stream itself stands only at its first row in a task. With ``pieces`` there are
    also ``raw`` and ``out``, what each token of markup is and becomes (``raw`` is null where both are the same).
    """
    may = F.col("content").rlike(HINT) | F.col("heading_title").rlike(HINT)
    src = chunks.where(may & F.col("chunk_id").isNotNull()).select("chunk_id", host(F.col("source")).alias("host"), "content", "heading_title")
    names = ["chunk_id", "field", "host", "sid", "stream", *(("raw", "out") if pieces else ())]

    def run(frames):
        seen: set = set()
        for pdf in frames:
            rows = []
            if len(seen) > 200_000:
                seen.clear()
            for cid, h, *texts in pdf.itertuples(index=False):
                for field, text in enumerate(texts):
                    if text is None:
                        continue
                    toks = stream(text)
                    shapes = items(toks)
                    sid = xxhash.xxh3_64_intdigest("\n".join(shapes)) - (1 << 63)
                    row = (cid, field, h, sid, None if (h, sid) in seen else shapes)
                    seen.add((h, sid))
                    rows.append((*row, [text[t.start : t.end] if t.kind in KINDS else None for t in toks], [t.out for t in toks]) if pieces else row)
            yield pd.DataFrame(rows, columns=names)

    schema = "chunk_id string, field int, host string, sid bigint, stream array<string>" + (", raw array<string>, out array<string>" if pieces else "")
    return persist_table(src.mapInPandas(run, schema), "markup-streams")


def readings(table: DataFrame) -> DataFrame:
    """``(host, sid, markup)``: every distinct stream of the table read through the wrapper of its host; ``markup`` lists
    the places its items of markup match. A host's streams meet its wrapper in parts of about ``READ_ROWS``."""
    streams = table.where("stream IS NOT NULL").groupBy("host", "sid").agg(F.first("stream").alias("stream"))
    made = persist_table(folded(streams.withColumn("chunks", F.lit(1).cast("bigint"))), "markup-wrappers")
    parts = F.ceil(F.col("streams") / READ_ROWS).cast("int")
    sent = made.select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "wrapper")
    cut = made.select(F.col("host").alias("h"), parts.alias("parts"))
    asked = streams.join(cut, F.col("host") == F.col("h")).select("host", F.pmod("sid", F.col("parts")).cast("int").alias("part"), "sid", "stream")

    def run(key, rows, wrapper):
        out = []
        if len(rows):
            reader = Reader([frozen(x) for x in json.loads(wrapper["wrapper"].iloc[0])])
            for sid, x in zip(rows["sid"], rows["stream"]):
                got = reader.markup(list(x))
                if got is None:
                    raise ValueError(f"the wrapper of {key[0]} does not match one of its streams")
                out.append((key[0], sid, got))
        return pd.DataFrame(out, columns=["host", "sid", "markup"])

    return asked.groupBy("host", "part").cogroup(sent.groupBy("host", "part")).applyInPandas(run, "host string, sid bigint, markup array<int>")


def with_markup(table: DataFrame) -> DataFrame:
    """Rows of the table with the ``markup`` their host's wrapper finds in them; rows without any are left out. A stream
    that very many rows share is cut into ``SALT`` parts for the join."""
    read = readings(table).where(F.size("markup") > 0).select(F.col("host").alias("h"), F.col("sid").alias("s"), "markup", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("z"))
    rows = table.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALT)).cast("int"))
    return rows.join(read, (F.col("host") == F.col("h")) & (F.col("sid") == F.col("s")) & (F.col("salt") == F.col("z"))).drop("h", "s", "z", "salt")


def residue(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` of every chunk whose content or heading title holds markup, once per ``chunk_id``.

    The token streams of a host are aligned to a wrapper, and each is read through it: what items of markup match is
    residue; the rest fills text slots or is the store's own form (fences, inline code, formulas), which is never looked
    into. Null and empty texts hold none; rows repeated with the same id give one row; a null id gives none.
    """
    return with_markup(examined(chunks)).select("chunk_id").distinct()


def cleaned(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, text, title)`` for every distinct chunk with markup: headings, lists, code and formulas are kept.

    Of each text the tokens that the wrapper of its host names markup are replaced by what stands for them; texts
    without any stay as they are. Rows repeated with the same id give one row.
    """
    table = examined(chunks, True)
    found = with_markup(table.select("chunk_id", "field", "host", "sid", "stream")).select(F.col("chunk_id").alias("c"), F.col("field").alias("f"), "markup").groupBy("c", "f").agg(F.max("markup").alias("markup"))
    rows = table.join(found.select(F.col("c").alias("chunk_id")).distinct(), "chunk_id", "left_semi").join(found, (F.col("chunk_id") == F.col("c")) & (F.col("field") == F.col("f")), "left")
    joined = F.array_join(F.transform("out", lambda o, i: F.when(F.array_contains("markup", i), o).otherwise(F.coalesce(F.get("raw", i), o))), "")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")
    rows = rows.select("chunk_id", "field", F.when(F.col("markup").isNull(), F.array_join(F.transform("out", lambda o, i: F.coalesce(F.get("raw", i), o)), "")).otherwise(tidy).alias("text"))
    return rows.groupBy("chunk_id").agg(F.max(F.when(F.col("field") == 0, F.col("text"))).alias("text"), F.max(F.when(F.col("field") == 1, F.col("text"))).alias("title"))


#: Hash buckets of a host in the rounds of a fold; the last has one.
ROUNDS = (1 << 18, 1 << 12, 1 << 6, 1)


def folded(streams: DataFrame) -> DataFrame:
    """``(host, wrapper, streams, chunks)`` of ``(host, sid, stream, chunks)``: the wrapper of each host as JSON.

    All distinct streams of a host, in full length, are folded: first those of a hash bucket, then in rounds the wrappers
    of 64 buckets each, so that a task sees few of them at once and the result matches every stream.
    """
    got = streams.select("host", F.pmod("sid", F.lit(ROUNDS[0])).alias("bucket"), F.to_json("stream").alias("wrapper"), F.lit(1).cast("bigint").alias("streams"), "chunks")
    for r, buckets in enumerate(ROUNDS):

        def run(frames, first=r == 0):
            for pdf in frames:
                made = []
                for few in pdf["wrappers"]:
                    w = infer([json.loads(x) for x in few]) if first else fold([[frozen(y) for y in json.loads(x)] for x in few])
                    made.append(json.dumps(w))
                yield pdf.drop(columns="wrappers").assign(wrapper=made)[["host", "bucket", "wrapper", "streams", "chunks"]]

        got = got.withColumn("bucket", F.col("bucket") % buckets).groupBy("host", "bucket").agg(F.collect_list("wrapper").alias("wrappers"), F.sum("streams").alias("streams"), F.sum("chunks").alias("chunks"))
        got = got.mapInPandas(run, "host string, bucket bigint, wrapper string, streams bigint, chunks bigint")
    return got.select("host", "wrapper", "streams", "chunks")


def wrappers(chunks: DataFrame) -> DataFrame:
    """``(host, wrapper, streams, chunks)``: a union-free regular expression over the token streams of each host.

    Text is a slot ``T``; mismatches became optional (``?``) or repeated (``+``, ``*``) tokens and groups. Streams without
    markup take part too. Null sources share the empty host; ``chunks`` counts texts, contents and titles.
    """
    table = examined(chunks)
    size = table.groupBy("host", "sid").agg(F.max("stream").alias("stream"), F.count(F.lit(1)).alias("chunks"))

    @F.pandas_udf("string")
    def shown(w: pd.Series) -> pd.Series:
        return w.map(lambda x: expression([frozen(y) for y in json.loads(x)]))

    return folded(size).withColumn("wrapper", shown("wrapper"))
