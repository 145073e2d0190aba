"""XML to Markdown-like sections."""

from __future__ import annotations

import re
from xml.etree import ElementTree


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attributes(e) -> str:
    return "".join(f"[{local(k)}={v}]" for k, v in e.attrib.items())


def own_text(e) -> str:
    return re.sub(r"\s+", " ", "".join([e.text or "", *[c.tail or "" for c in e]])).strip()


def descendant_lines(e, path: str) -> list[str]:
    """``a > b[attr=v]: text`` for every descendant that holds text or attributes."""
    out = []
    for c in e:
        if not isinstance(c.tag, str):
            continue
        here = f"{path} > {local(c.tag)}{attributes(c)}" if path else f"{local(c.tag)}{attributes(c)}"
        text = own_text(c)
        if text or c.attrib:
            out.append(f"{here}: {text}" if text else here)
        out += descendant_lines(c, here)
    return out


def repeats(e) -> set[str]:
    seen, twice = set(), set()
    for c in e:
        if isinstance(c.tag, str):
            name = local(c.tag)
            (twice if name in seen else seen).add(name)
    return twice


def deep_repeats(e) -> bool:
    return any(repeats(c) or deep_repeats(c) for c in e if isinstance(c.tag, str))


def sections(e, path: str, size: int, boundary: frozenset[str]) -> list[str]:
    name = local(e.tag)
    here = f"{path} > {name}" if path else name
    kids = [c for c in e if isinstance(c.tag, str)]
    marked = [c for c in kids if local(c.tag) in boundary]
    twice = {local(c.tag) for c in marked} if marked else set() if boundary and any(local(x.tag) in boundary for x in e.iter() if x is not e) else repeats(e)
    if boundary and not marked:
        if any(isinstance(x.tag, str) and local(x.tag) in boundary for x in e.iter() if x is not e):
            return [s for c in kids for s in sections(c, here, size, boundary)]
    if not twice:
        if deep_repeats(e):
            return [s for c in kids for s in sections(c, here, size, boundary)]
        lines = descendant_lines(e, "")
        text = own_text(e)
        lines = ([text] if text else []) + lines
        return [f"## {here}\n\n" + "\n".join(lines)] if lines else []
    if not marked and any(local(c.tag) in twice and (repeats(c) or deep_repeats(c)) for c in kids):
        return [s for c in kids for s in sections(c, here, size, boundary)]
    out: list[str] = []
    last = max(i for i, c in enumerate(kids) if local(c.tag) in twice)

    def unique(part) -> list[str]:
        lines = []
        for c in part:
            if local(c.tag) not in twice:
                text = own_text(c)
                label = f"{local(c.tag)}{attributes(c)}"
                if text or c.attrib:
                    lines.append(f"{label}: {text}" if text else label)
                lines += descendant_lines(c, label)
        return lines

    before = ([f"{name}{attributes(e)}"] if e.attrib else []) + unique(kids[:last])
    if before:
        out.append(f"## {here}\n\n" + "\n".join(before))
    buffer: list[str] = []
    tag = ""

    def flush() -> None:
        nonlocal buffer
        if buffer:
            out.append(f"## {here} > {tag}\n\n" + "\n".join(buffer))
        buffer = []

    for c in kids:
        t = local(c.tag)
        if t not in twice:
            continue
        lines = descendant_lines(c, "")
        text = own_text(c)
        if len("\n".join(lines)) >= 3 * size:
            flush()
            out.append(f"## {here} > {t}{attributes(c)}\n\n" + "\n".join(lines))
            continue
        if t != tag or sum(map(len, buffer)) >= 12 * size:
            flush()
            tag = t
        label = f"{t}{attributes(c)}"
        buffer.append("\n".join([f"{label}: {text}" if text else label, *lines]) if text or c.attrib or not lines else "\n".join(lines))
    flush()
    after = unique(kids[last + 1 :])
    if after:
        out.append(f"## {here}\n\n" + "\n".join(after))
    return out


def xml_to_markdown(xml: str, boundary: tuple[str, ...] = (), size: int = 1000) -> str:
    """Sections ``## path`` at the deepest level of repeated siblings (or at ``boundary`` tags); text of broken XML is empty.

    Names are local, namespaces and comments fall away, CDATA stays. Small repeated elements share a section; one
    element of ``3 * size`` characters or more has its own, in which only its descendants are written.
    """
    try:
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?\s*>", "", xml, count=1))
    except ElementTree.ParseError:
        return ""
    return "\n\n".join(sections(root, "", size, frozenset(boundary)))
