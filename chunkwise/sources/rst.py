"""reStructuredText and AsciiDoc to Markdown-like text."""

from __future__ import annotations

import re

PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
DIRECTIVE = re.compile(r"^\.\. (?:code-block|code|sourcecode|highlight|literalinclude)::")
OTHER = re.compile(r"^\.\. ")


def ruler(line: str) -> str | None:
    """The punctuation character of a line made of nothing else."""
    s = line.rstrip()
    return s[0] if s and s[0] in PUNCTUATION and set(s) == {s[0]} else None


def rst_to_markdown(text: str) -> str:
    """Headings by over- and underlines (levels in order of first appearance of the character), code by directives or
    ``::`` as bare fences, other directives dropped. Blocks of code are trimmed at the left."""
    lines = text.replace("\r\n", "\n").split("\n")
    heads: dict[int, tuple[int, str, str]] = {}
    order: list[str] = []
    i = 0
    while i < len(lines):
        a = ruler(lines[i])
        title = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if a and i + 2 < len(lines) and title and not ruler(title) and ruler(lines[i + 2]) == a and min(len(lines[i].rstrip()), len(lines[i + 2].rstrip())) >= len(title):
            heads[i] = (3, a, title)
            i += 3
        elif not a and lines[i].strip() and i + 1 < len(lines) and ruler(lines[i + 1]) and len(lines[i + 1].rstrip()) >= len(lines[i].strip()):
            heads[i] = (2, ruler(lines[i + 1]), lines[i].strip())
            i += 2
        else:
            i += 1
            continue
        c = heads[max(heads)][1]
        if c not in order:
            order.append(c)
    out: list[str] = []
    i = 0
    while i < len(lines):
        if i in heads:
            n, c, title = heads[i]
            out.append("#" * (order.index(c) + 1) + " " + title)
            i += n
            continue
        line = lines[i]
        if DIRECTIVE.match(line) or line.rstrip().endswith("::"):
            if not DIRECTIVE.match(line) and line.strip() != "::" and not OTHER.match(line):
                out.append(line.rstrip()[:-1])
            j = i + 1
            while j < len(lines) and (not lines[j].strip() or re.match(r"^\s+:\w+:", lines[j])):
                j += 1
            body = []
            while j < len(lines) and (not lines[j].strip() or lines[j][0] in " \t"):
                body.append(lines[j].lstrip())
                j += 1
            while body and not body[-1]:
                body.pop()
            if body:
                out += ["```", *body, "```", ""]
            i = max(j, i + 1)
            continue
        if OTHER.match(line):
            i += 1
            continue
        out.append(line)
        i += 1
    return "\n".join(out)


def asciidoc_to_markdown(text: str) -> str:
    """Listing delimiters as bare fences, ``=`` headings as ``#`` headings (inside listings too, as for Markdown)."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        m = re.match(r"^(=+)\s+(.+)$", line)
        out.append("```" if re.fullmatch(r"\s*-{4,}\s*", line) else "#" * len(m.group(1)) + " " + m.group(2) if m else line)
    return "\n".join(out)


def rtf_to_text(rtf: str) -> str:
    """Plain text of RTF: groups of fonts, colours, styles and pictures are left out; escapes are decoded."""
    out: list[str] = []
    stack: list[bool] = []
    hidden, skip, at = False, 0, 0
    token = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
    while at < len(rtf):
        m = token.match(rtf, at)
        if not m:
            at += 1
            continue
        at = m.end()
        word, number, code, sign, brace, text = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"):
            hidden = True
        elif hidden:
            continue
        elif word in ("par", "line", "sect", "page", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = 1
        elif code:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign:
            out.append({"~": "\xa0", "_": "-"}.get(sign, sign if sign in "\\{}" else ""))
        elif text:
            out.append(text[skip:] if skip else text)
            skip = 0
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()
