"""Pages as trees of block elements, for a batch of pages at a time.

A small tolerant reader: it walks tags and text once, keeps block elements as nodes
and folds inline markup into them, and gives every node a handful of features.
Scripts, styles, text fields and comments never become text.  A trailing slash closes
nothing, as in HTML; void elements are no nodes, they only part the text; elements
nested deeper than ``DEEPEST`` stand side by side, as in browsers.  Text that stands in
the page itself, beside its blocks, is a block of its own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

# Element groups and naming hints that describe a node.
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object textarea title svg".split())
TAGS = ["html", "head", "title", "body", "main", "article", "section", "div", "header", "footer", "nav", "aside", "form", "p", "h1", "h2", "h3", "h4", "h5", "h6"]
TAGS += ["ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address", "button", "label", "select", "option"]
TAGS += ["textarea", "input", "dialog", "menu", "details", "summary", "hgroup", "center", "other"]
HINTS = ["article", "post", "entry", "content", "main", "body", "story", "text", "page", "wrap", "nav", "menu", "breadcrumb", "header", "head", "foot", "side", "ad", "ads", "advert"]
HINTS += ["sponsor", "promo", "banner", "cookie", "notice", "consent", "alert", "popup", "modal", "subscribe", "newsletter", "form", "search", "login", "comment", "reply", "disqus"]
HINTS += ["share", "social", "related", "recommend", "widget", "pagination", "tags", "copyright", "legal", "toolbar", "title", "byline", "caption"]
_TAG = {t: i for i, t in enumerate(TAGS)}
_HINT = {h: i for i, h in enumerate(HINTS)}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
N_NUMBERS = 7
DEEPEST = 512
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")


def hints(attributes: str) -> list[int]:
    """Hints named by class, id or role: whole parts of a name, or its beginning."""
    found = set()
    for value in _NAMED.findall(attributes):
        for part in _PART.findall("".join(value)):
            part = part.lower()
            for known in (part, part.rstrip("s"), *((part[:n] for n in range(4, len(part))))):
                if known in _HINT:
                    found.add(_HINT[known])
    return sorted(found)


def by_level(level: np.ndarray) -> list[np.ndarray]:
    """Nodes of each level, in their order."""
    order = np.argsort(level, kind="stable")
    return np.split(order, np.cumsum(np.bincount(level))[:-1]) if len(level) else [order]


@dataclass
class Forest:
    """Nodes of many pages: parents come before children."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)  # -1: as the parent; for labelled pages
    hint_node: list[int] = field(default_factory=list)
    hint: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, int, str]] = field(default_factory=list)  # page, node, block, text; in page order
    pages: int = 0
    block: int = 0  # rises at every block tag and line break

    def add(self, source: str) -> None:
        page, self.pages = self.pages, self.pages + 1
        stack: list[tuple[str, int]] = [("", self._node(page, -1, "other", ""))]
        opened: Counter[str] = Counter()
        link, at, end = 0, 0, len(source)
        loose, label = -1, -1  # the block of text that stands in the page itself, without an element of its own

        def close() -> None:
            opened[stack.pop()[0]] -= 1

        for token in iter(lambda: _TOKEN.match(source, at) if at < end else None, None):
            at = token.end()
            name = token[2] or token[5]
            if not name:
                text = token[0]
                if text[:2] in ("<!", "<?", "</"):
                    continue
                node = stack[-1][1]
                if stack[-1][0] in ("", "html", "body") and (loose >= 0 or not text.isspace()):
                    if loose < 0:
                        loose = self._node(page, node, "other", "")
                        self.marked[loose] = label
                    node = loose
                self._text(page, node, text, link)
                continue
            name, closing, rest = name.lower(), token[1] or token[4], token[3] or token[6] or ""
            if name in RAW:
                if not closing:
                    stop = _ENDS[name].search(source, at)
                    at = stop.end() if stop else end
                continue
            if name in INLINE and name != "br":
                if name == "a":
                    link = 0 if closing else 1
                continue
            self.block += 1
            if name in VOID:
                continue
            link, loose = 0, -1
            if name == "body" and 'data-loose="1"' in rest:
                label = 1
            if closing:
                while opened[name] and stack[-1][0] != name:
                    close()
                if opened[name]:
                    close()
                continue
            if stack[-1][0] == "p" and name not in ("button", "label", "select", "option"):
                close()
            while stack[-1][0] in _CLOSES.get(name, ()):
                close()
            stack.append((name, self._node(page, stack[min(len(stack), DEEPEST) - 1][1], name, rest)))
            opened[name] += 1
        self.block += 1

    def _node(self, page: int, parent: int, name: str, attributes: str) -> int:
        node = len(self.page)
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(_TAG.get(name, _TAG["other"]))
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        mark = re.search(r'data-main="([01])"', attributes) if "data-main" in attributes else None
        self.marked.append(int(mark[1]) if mark else -1)
        for h in hints(attributes) if attributes else ():
            self.hint_node.append(node)
            self.hint.append(h)
        self.chars.append(0)
        self.linked.append(0)
        self.marks.append(0)
        return node

    def _text(self, page: int, node: int, text: str, link: int) -> None:
        text = html.unescape(text) if "&" in text else text
        n = len(text)
        self.chars[node] += n
        self.linked[node] += n * link
        self.marks[node] += text.count(".") + text.count(",")
        self.texts.append((page, node, self.block, text))

    def arrays(self) -> dict[str, np.ndarray]:
        parent, level, tag = (np.array(x, np.int64) for x in (self.parent, self.level, self.tag))
        chars, linked, marks = (np.array(x, float) for x in (self.chars, self.linked, self.marks))
        below, below_linked = chars.copy(), linked.copy()
        for at in reversed(by_level(level)[1:]):
            np.add.at(below, parent[at], below[at])
            np.add.at(below_linked, parent[at], below_linked[at])
        kids = np.bincount(parent[parent >= 0], minlength=len(parent))
        outer = np.isin(tag[np.maximum(parent, 0)], [_TAG["body"], _TAG["html"]]) | (level < 2)  # stands in the page itself
        numbers = np.stack(
            [np.log1p(chars) / 5, np.log1p(below) / 5, np.where(chars > 0, linked / np.maximum(chars, 1), 0), np.where(below > 0, below_linked / np.maximum(below, 1), 0), np.minimum(marks / np.maximum(chars, 1) * 20, 2), np.log1p(kids) / 3, outer.astype(float)],
            axis=1,
        )
        return {"page": np.array(self.page, np.int64), "parent": parent, "level": level, "tag": tag, "numbers": numbers, "hint_node": np.array(self.hint_node, np.int64), "hint": np.array(self.hint, np.int64), "marked": np.array(self.marked, np.int64)}

    def main_texts(self, content: np.ndarray) -> list[str]:
        """Each page's text of the nodes marked as content; white space runs are one space."""
        pieces: list[list[str]] = [[] for _ in range(self.pages)]
        last = -1
        for page, node, block, text in self.texts:
            if content[node]:
                if block != last:
                    pieces[page].append(" ")
                pieces[page].append(text)
                last = block
        return [_WHITE.sub(" ", "".join(p)).strip(" ") for p in pieces]
