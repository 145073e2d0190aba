"""HTML to Markdown-like text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements whose whole content is left out, and elements without an end tag.
SKIPPED = frozenset("script style noscript nav header footer aside template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING_CLASS = re.compile(r"(?:^|\s)(?:h|heading-)([1-6])(?:\s|$)")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class Tree(HTMLParser):
    """A lenient tree: unknown end tags are ignored, open elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    t = Tree()
    t.feed(html)
    t.close()
    return t.root


def walk(node: Node):
    yield node
    for c in node.children:
        if isinstance(c, Node):
            yield from walk(c)


def inner_text(node: Node) -> str:
    parts: list[str] = []

    def take(n) -> None:
        for c in n.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append(" ")
            elif c.tag not in SKIPPED:
                take(c)

    take(node)
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def render(node: Node) -> str:
    out: list[str] = []
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                out.append(re.sub(r"\s+", " ", c))
            continue
        tag = c.tag
        if tag in SKIPPED or tag in ("head", "title"):
            continue
        if re.fullmatch("h[1-6]", tag):
            out.append(f"\n{'#' * int(tag[1])} {inner_text(c)}\n\n")
        elif tag == "p":
            out.append(render(c).strip() + "\n\n")
        elif tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n---\n\n")
        elif tag == "pre":
            body = "".join(x if isinstance(x, str) else inner_raw(x) for x in c.children)
            out.append(f"\n```\n{body.strip(chr(10))}\n```\n\n")
        elif tag == "img":
            if c.attrs.get("alt"):
                out.append(c.attrs["alt"])
        elif tag in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
            out.append("\n" + "".join(f"{f'{i}.' if tag == 'ol' else '-'} {inner_text(x)}\n" for i, x in enumerate(items, 1)) + "\n")
        elif tag == "blockquote":
            lines = [x for x in render(c).split("\n") if x.strip()]
            out.append("\n" + "".join(f"> {x.strip()}\n" for x in lines) + "\n")
        elif tag == "table":
            out.append(table(c))
        else:
            level = HEADING_CLASS.search(c.attrs.get("class", ""))
            out.append(f"\n{'#' * int(level.group(1))} {inner_text(c)}\n\n" if level else render(c))
    return "".join(out)


def inner_raw(node: Node) -> str:
    return "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else inner_raw(x) for x in node.children)


def table(node: Node) -> str:
    out, ruled = ["\n"], False
    for row in (n for n in walk(node) if n.tag == "tr"):
        cells = [x for x in row.children if isinstance(x, Node) and x.tag in ("td", "th")]
        if not cells:
            continue
        out.append("| " + " | ".join(inner_text(x) for x in cells) + " |\n")
        if not ruled and any(x.tag == "th" for x in cells):
            out.append("| " + " | ".join("---" for _ in cells) + " |\n")
            ruled = True
    return "".join([*out, "\n"])


def html_to_markdown(html: str) -> str:
    """Body text with headings, lists, quotes, code blocks, rules and tables; boilerplate elements are left out.

    Links and emphasis keep their text only. A class such as ``h2`` or ``heading-2`` makes any element a heading.
    """
    root = tree(html)
    body = next((n for n in walk(root) if n.tag == "body"), root)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", render(body))).strip()


def html_title(html: str) -> str | None:
    node = next((n for n in walk(tree(html)) if n.tag == "title"), None)
    return inner_text(node) or None if node else None
