"""A small DOM of a page and the features of its nodes.

``Pages`` gathers many pages into flat lists: elements in document order and
leaves, which are the visible pieces of text of one line each. A leaf range
belongs to each element, so the statistics of any subtree are differences of
running sums, for all pages of a batch at once. A text page has an element for
each paragraph.
"""

from __future__ import annotations

import html
import re

import numpy as np

# Elements without content, without visible text, that end an open paragraph, and what ends what.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"head", "template", "noscript", "svg", "canvas", "iframe", "object", "select", "datalist"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav",
    "ol", "p", "pre", "section", "table", "ul", "li", "tr", "td", "th", "dt", "dd",
}
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
UNSEEN_SIGNS = " \u00a0\u200b\ufeff\u00ad"
TAGS = ["", "html", "body", "main", "article", "section", "div", "aside", "nav", "header", "footer", "form", "ul", "ol", "li", "table", "tr", "td", "th", "dl", "dt", "dd", "p", "h1", "h2", "h3", "h4", "a", "b", "strong", "i", "em", "span", "font", "button", "label", "blockquote", "pre", "text", "paragraph"]
TAG_CODE = {t: i for i, t in enumerate(TAGS)}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|!?\??(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|type)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_ENDS = {".": 1, ":": 3, "?": 4, "!": 5, "…": 2}


def leaf_words(text: str) -> list[str]:
    """Lower-case words; every number is the word 0."""
    return [w if not w.isdigit() else "0" for w in _WORD.findall(text.lower())]


class Pages:
    """Flat lists over all pages added. Leaf: line, text, element. Element: parent, tag, attribute words, leaf range, place among siblings."""

    def __init__(self) -> None:
        self.first_leaf, self.first_element = [0], [0]
        self.line: list[int] = []
        self.text: list[str] = []
        self.of: list[int] = []
        self.linked: list[bool] = []
        self.parent: list[int] = []
        self.tag: list[int] = []
        self.attrs: list[tuple[str, ...]] = []
        self.depth: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.nth: list[int] = []
        self.children: list[int] = []
        self._known_attrs: dict[str, tuple[tuple[str, ...], bool]] = {}

    def _open(self, parent: int, tag: int, attrs: tuple[str, ...]) -> int:
        e = len(self.tag)
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.start.append(len(self.text))
        self.end.append(-1)
        self.children.append(0)
        if parent >= 0:
            self.nth.append(self.children[parent])
            self.children[parent] += 1
        else:
            self.nth.append(0)
        return e

    def _leaf(self, line: int, text: str, element: int, linked: bool) -> None:
        self.line.append(line)
        self.text.append(text)
        self.of.append(element)
        self.linked.append(linked)

    def _attributes(self, raw: str) -> tuple[tuple[str, ...], bool]:
        known = self._known_attrs.get(raw)
        if known is None:
            words, unseen = [], False
            for m in _ATTR.finditer(raw):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id", "role"):
                    words += _PART.findall(value)
                elif name == "style":
                    flat = value.replace(" ", "")
                    unseen |= "display:none" in flat or "visibility:hidden" in flat
                elif name == "hidden":
                    unseen = True
                elif name == "aria-hidden":
                    unseen |= value == "true"
            known = (tuple(words), unseen)
            if len(self._known_attrs) < 100_000:
                self._known_attrs[raw] = known
        return known

    def add_text(self, content: str) -> None:
        root = self._open(-1, TAG_CODE["text"], ())
        part = -1
        for number, line in enumerate(content.split("\n"), 1):
            seen = line.strip()
            if not seen:
                part = -1
                continue
            if part < 0:
                part = self._open(root, TAG_CODE["paragraph"], ())
            self._leaf(number, seen, part, False)
            self.end[part] = len(self.text)
        self.end[root] = len(self.text)
        self._done()

    def add_html(self, content: str) -> None:
        root = self._open(-1, TAG_CODE["html"], ())
        stack: list[tuple[str, int, bool]] = [("html", root, False)]  # name, element, unseen
        links, unseen, line, at = 0, 0, 1, 0
        count, find = content.count, content.find

        def close(to: int) -> None:
            nonlocal links, unseen
            while len(stack) > to:
                name, element, hides = stack.pop()
                self.end[element] = len(self.text)
                links -= name == "a"
                unseen -= hides

        def put(piece: str) -> None:
            nonlocal line
            if unseen or not piece.strip():
                line += piece.count("\n")
                return
            element, linked = stack[-1][1], links > 0
            parts = piece.split("\n")
            for k, part in enumerate(parts):
                if "&" in part:
                    part = html.unescape(part)
                seen = part.strip().strip(UNSEEN_SIGNS)
                if seen:
                    self._leaf(line + k, seen, element, linked)
            line += len(parts) - 1

        for m in _TAG.finditer(content):
            a, b = m.span()
            if a > at:
                put(content[at:a])
            at = b
            name = m[3]
            if name is None:
                line += count("\n", a, b)
                continue
            if find("\n", a, b) >= 0:
                line += count("\n", a, b)
            name = name.lower()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                continue
            if name in VOID or name == "doctype":
                continue
            if name == "html":
                continue
            if name in BLOCK and stack[-1][0] == "p":
                close(len(stack) - 1)
            if name in ENDS:
                ended, within = ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in within:
                        break
                    if stack[k][0] in ended:
                        close(k)
                        break
            attrs, hidden = self._attributes(m[4]) if m[4] else ((), False)
            hides = hidden or name in UNSEEN
            element = self._open(stack[-1][1], TAG_CODE.get(name, 0), attrs)
            stack.append((name, element, hides))
            unseen += hides
            links += name == "a"
        if at < len(content):
            put(content[at:])
        close(0)
        self.end[root] = len(self.text)
        self._done()

    def _done(self) -> None:
        self.first_leaf.append(len(self.text))
        self.first_element.append(len(self.tag))

    def add(self, content: str | None, kind: str | None) -> None:
        """A page; by its content if its kind is neither html nor text. A null page has no leaves."""
        if content and (kind == "html" or kind != "text" and re.search(r"<(?:html|body|div|p|table|br)\b", content, re.I)):
            self.add_html(content)
        else:
            self.add_text(content or "")


class LeafText:
    """Numbers of a leaf's own text, remembered for texts that recur. words, attrs: learned scores."""

    #: chars, words, learned score, share of capitals, share of digits, ending, colon or bar, learned score of the whole line
    WIDTH = 8

    def __init__(self, words: dict[str, float], lines: dict[str, float]) -> None:
        self.words, self.lines = words, lines
        self.known: dict[str, tuple[float, ...]] = {}

    def __call__(self, text: str) -> tuple[float, ...]:
        got = self.known.get(text)
        if got is None:
            words = leaf_words(text)
            score = sum(self.words.get(w, 0.0) for w in words) / max(1, len(words))
            ends = 2 if text.endswith("...") else _ENDS.get(text[-1], 0)
            n = len(text)
            mark = 1 if " | " in text else 2 if ": " in text else 3 if " > " in text else 4 if "@" in text else 0
            digits = sum(map(str.isdigit, text)) / n
            got = (float(n), float(len(words)), score, sum(map(str.isupper, text)) / n, digits, float(ends), float(mark), self.lines.get(" ".join(words), 0.0))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = got
        return got


def node_features(pages: Pages, leaf_text: LeafText, attr_scores: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Features of elements and of leaves."""
    n, m = len(pages.text), len(pages.tag)
    own = np.array([leaf_text(t) for t in pages.text], dtype=np.float32).reshape(n, LeafText.WIDTH)
    linked = np.array(pages.linked, dtype=np.float32)
    chars = own[:, 0]
    base = np.stack([np.ones(n, np.float32), chars, own[:, 1], own[:, 2], linked * chars, own[:, 5] == 1, own[:, 5] == 2, own[:, 4], own[:, 7], own[:, 3]], axis=1).astype(np.float64)
    run = np.vstack([np.zeros((1, base.shape[1])), np.cumsum(base, axis=0)])
    first_leaf, first_element = np.array(pages.first_leaf), np.array(pages.first_element)
    page_of_element = np.repeat(np.arange(len(first_element) - 1), np.diff(first_element))
    page_of_leaf = np.repeat(np.arange(len(first_leaf) - 1), np.diff(first_leaf))
    start, end = np.array(pages.start, dtype=np.int64), np.array(pages.end, dtype=np.int64)
    known: dict[tuple[str, ...], float] = {}
    attr = np.zeros(m, dtype=np.float32)
    for i, a in enumerate(pages.attrs):
        if a:
            s = known.get(a)
            if s is None:
                s = known[a] = sum(attr_scores.get(w, 0.0) for w in a)
            attr[i] = s
    parent = np.array(pages.parent, dtype=np.int64)
    up = np.where(parent < 0, np.arange(m), parent)
    tag, depth = np.array(pages.tag, dtype=np.float32), np.array(pages.depth, dtype=np.float32)
    nth, children = np.array(pages.nth, dtype=np.float32), np.array(pages.children, dtype=np.float32)

    def stats(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = run[b] - run[a]
        k, c = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
        return np.stack([s[:, 0], s[:, 1], s[:, 2] / k, s[:, 3] / k, s[:, 4] / c, s[:, 5] / k, s[:, 6] / k, s[:, 7] / k, s[:, 8] / k, s[:, 9] / k], axis=1)

    def around(a: np.ndarray, b: np.ndarray, page: np.ndarray) -> np.ndarray:
        low, high = first_leaf[page], first_leaf[page + 1]
        cols = []
        for width in (1, 2, 4, 8):
            before, after = np.maximum(a - width, low), np.minimum(b + width, high)
            left, right = run[a] - run[before], run[after] - run[b]
            cols += [left[:, 3] / np.maximum(left[:, 0], 1), right[:, 3] / np.maximum(right[:, 0], 1)]
            if width in (1, 4):
                cols += [left[:, 8] / np.maximum(left[:, 0], 1), right[:, 8] / np.maximum(right[:, 0], 1), left[:, 4] / np.maximum(left[:, 1], 1), right[:, 4] / np.maximum(right[:, 1], 1)]
        size = np.maximum(high - low, 1)
        return np.stack([*cols, (a - low) / size, (high - b) / size, size], axis=1)

    own_stats = stats(start, end) if m else np.zeros((0, 10))
    density = own_stats[:, 1] / np.maximum(end - start + children, 1) if m else np.zeros(0)
    element = np.stack([tag, attr, depth, children, nth, children[up] - nth, density], axis=1) if m else np.zeros((0, 7))
    up_stats = own_stats[up]
    x_element = np.hstack([own_stats, up_stats, element, tag[up, None], attr[up, None], attr[up[up], None], around(start, end, page_of_element), np.zeros((m, 7)), np.ones((m, 1))])
    of = np.array(pages.of, dtype=np.int64)
    i = np.arange(n)
    leaf_place = np.stack([tag[of], attr[of], depth[of] + 1, np.zeros(n), i - start[of], end[of] - i, chars], axis=1) if n else np.zeros((0, 7))
    x_leaf = np.hstack([stats(i, i + 1), own_stats[of], leaf_place, tag[up[of], None], attr[up[of], None], attr[up[up[of]], None], around(i, i + 1, page_of_leaf), own[:, 1:], np.zeros((n, 1))]) if n else np.zeros((0, x_element.shape[1]))
    return x_element.astype(np.float32), x_leaf.astype(np.float32)


def decode(pages: Pages, element_score: np.ndarray, leaf_score: np.ndarray) -> np.ndarray:
    """Whether each leaf is main text, by ``labelling``."""
    stays = labelling(pages, element_score, leaf_score)
    of = np.array(pages.of, dtype=np.int64)
    return stays[of] & (leaf_score > 0) if len(of) else np.zeros(0, dtype=bool)


def labelling(pages: Pages, element_score: np.ndarray, leaf_score: np.ndarray) -> np.ndarray:
    """Whether each element is main: the best labelling in which a node is main only inside a main element.

    Bottom up, a node is worth its score and what its children are worth, or nothing if that is negative; top
    down, a node stays if it is worth something and its parent stays. A page's root stays.
    """
    parent, depth = np.array(pages.parent, dtype=np.int64), np.array(pages.depth, dtype=np.int64)
    of = np.array(pages.of, dtype=np.int64)
    worth = element_score.astype(np.float64).copy()
    leaf_worth = np.maximum(leaf_score, 0)
    if len(of):
        worth += np.bincount(of, leaf_worth, len(worth))
    order = np.argsort(-depth, kind="stable")
    bounds = np.flatnonzero(np.diff(-depth[order], prepend=-(depth.max(initial=0) + 1))) if len(order) else []
    levels = np.split(order, bounds[1:]) if len(order) else []
    for level in levels:
        up = parent[level]
        inside = up >= 0
        np.add.at(worth, up[inside], np.maximum(worth[level[inside]], 0))
    stays = np.zeros(len(worth), dtype=bool)
    for level in reversed(levels):
        up = parent[level]
        stays[level] = np.where(up < 0, True, stays[np.maximum(up, 0)] & (worth[level] > 0))
    return stays
