"""Visible text, prepared text, title and notices of a page, by one pass over its tree.

The page is parsed once for each row into a struct; select its fields instead of
calling the function again. Built on the standard library's tokenizer.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# What is never read, read through, a block, without content, and preferred as the body of a page.
DROPPED_FOR_HASH = {"script", "style", "noscript", "template", "svg", "canvas"}
DROPPED_FOR_TEXT = DROPPED_FOR_HASH | {"iframe", "button"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "section", "article", "li", "dt", "dd", "tr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PREFERRED_CLASSES = ("jobdetail", "job-detail", "vacancy", "opdracht")
PREFERRED_TAGS = ("main", "article")
#: Least length of a preferred body.
LEAST_BODY = 500

SCHEMA = "visible string, prepared string, original_chars long, prepared_chars long, truncated boolean, title string"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)  # nodes and strings


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(content: str) -> Node:
    builder = _Builder()
    builder.feed(content)
    builder.close()
    return builder.root


def _styled_away(node: Node) -> bool:
    style = re.sub(r"\s", "", node.attrs.get("style", "")).lower()
    return "display:none" in style or "visibility:hidden" in style


def hidden_for_hash(node: Node) -> bool:
    return (
        node.tag in DROPPED_FOR_HASH or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true"
        or node.tag == "input" and node.attrs.get("type") == "hidden" or _styled_away(node)
    )


def hidden_for_text(node: Node) -> bool:
    return node.tag in DROPPED_FOR_TEXT or "hidden" in node.attrs or node.attrs.get("aria-hidden", "").strip().lower() == "true" or _styled_away(node)


def pieces(node: Node, hides) -> Iterator[str]:
    """Strings in document order without hidden subtrees; deep pages need no recursion."""
    stack = [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                yield child
            elif not hides(child):
                stack.append(iter(child.children))
                break
        else:
            stack.pop()


def visible_text(root: Node) -> str:
    joined = " ".join(s for p in pieces(root, hidden_for_hash) if (s := p.strip()))
    return " ".join(html.unescape(joined).split())


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not hidden_for_text(c)]


def _plain(node: Node) -> str:
    return " ".join(" ".join(pieces(node, hidden_for_text)).split())


def body_of(root: Node) -> Node:
    """The longest preferred element if it is long enough, else body, else the document."""
    best, longest, body = None, LEAST_BODY - 1, None
    for node in _walk(root):
        if node.tag == "body" and body is None:
            body = node
        classes = node.attrs.get("class", "").lower()
        if node.tag in PREFERRED_TAGS or any(c in classes for c in PREFERRED_CLASSES):
            n = len(_plain(node))
            if n > longest:
                best, longest = node, n
    return best or body or root


def prepared_text(root: Node) -> str:
    """Lines of the body: a line end around every block, blanks collapsed, no empty or repeated line."""
    out: list[str] = []
    stack: list = [body_of(root)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif not hidden_for_text(item):
            if item.tag in BLOCKS:
                out.append("\n")
                stack.append("\n")
            stack += reversed(item.children)
    lines: list[str] = []
    for line in "".join(out).replace("\u00a0", " ").splitlines():
        line = re.sub(r"[ \t]+", " ", line).strip()
        if line and (not lines or lines[-1] != line):
            lines.append(line)
    return "\n".join(lines)


def title_of(root: Node, generic: frozenset[str] = frozenset()) -> str | None:
    """The first heading that isn't generic, else a title for sharing, else the document's title up to the last dash."""
    heading = shared = own = None
    for node in _walk(root):
        if node.tag in ("h1", "h2", "h3") and heading is None:
            text = _plain(node)
            heading = text if text and text.lower() not in generic else None
        elif node.tag == "meta" and shared is None and (node.attrs.get("property") or node.attrs.get("name")) in ("og:title", "twitter:title"):
            shared = " ".join(node.attrs.get("content", "").split()) or None
        elif node.tag == "title" and own is None:
            own = _plain(node) or None
    cut = lambda s: s.rpartition(" - ")[0] or s
    for text in (heading, cut(shared) if shared else None, cut(own) if own else None):
        if text and text.lower() not in generic:
            return text
    return None


def parsed_page(content: Column, most: int = 60_000) -> Column:
    """Struct of SCHEMA. Null for a null page; texts are read whole and only the prepared one is cut, with a flag."""
    if most < 1000:
        raise ValueError("most must be at least 1000")

    @F.pandas_udf(SCHEMA)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for page in s:
                if page is None:
                    rows.append((None,) * 6)
                    continue
                root = tree(page)
                text = prepared_text(root)
                rows.append((visible_text(root), text[:most].rstrip(), len(page), min(len(text), most), len(text) > most, title_of(root)))
            yield pd.DataFrame(rows, columns=["visible", "prepared", "original_chars", "prepared_chars", "truncated", "title"])

    return parse(content)
