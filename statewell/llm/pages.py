"""A small DOM: tags, attributes and texts of a page as one flat list of nodes in document order."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

# Elements without an end tag, elements whose text is not markup, and elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes title svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the same kind, up to the nearest of the elements named.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Elements inside which an end tag or an implied end does not reach out.
SCOPE = frozenset("html body article section div main aside nav header footer form table td th ul ol dl blockquote fieldset".split())
INLINE_OPEN = frozenset("a abbr b big cite code em font i kbd mark q s samp small span strike strong sub sup tt u".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TAG_STOP = re.compile("[>\"']")


@dataclass
class Node:
    tag: str
    parent: int
    attrs: dict[str, str] = field(default_factory=dict)
    text: str = ""


class Open:
    """The open elements from the root down, with the places of each name, so that no end tag searches the stack."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        self.places: dict[str, list[int]] = defaultdict(list)
        # places of elements that keep ends inside, and of those that are not inline
        self.scopes: list[int] = []
        self.solid: list[int] = []

    def push(self, node: int) -> None:
        tag, at = self.nodes[node].tag, len(self.stack)
        self.stack.append(node)
        self.places[tag].append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        if tag not in INLINE_OPEN:
            self.solid.append(at)

    def cut(self, at: int) -> None:
        """Close what is open from this place on."""
        while len(self.stack) > at:
            self.places[self.nodes[self.stack.pop()].tag].pop()
        for places in (self.scopes, self.solid):
            while places and places[-1] >= at:
                places.pop()

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in names if self.places[t]), default=0)

    def close(self, names: tuple[str, ...], within: frozenset | tuple) -> None:
        """Close the innermost element of these names unless one of ``within`` lies inside it."""
        at = self.last(names)
        wall = (self.scopes[-1] if self.scopes else 0) if within is SCOPE else self.last(within)
        if at and at >= wall:
            self.cut(at)

    def close_paragraph(self) -> None:
        """A block ends an open paragraph with what is open in it; inline elements left open end with their block."""
        if self.solid and self.nodes[self.stack[self.solid[-1]]].tag == "p":
            self.cut(self.solid[-1])


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Position after the > of a tag; quotes may hide one, an unclosed quote does not.

    ``dead`` holds the quotes from which the page is known to end inside quotes, so that a page is searched once.
    """
    plain = page.find(">", at)
    if plain < 0:
        return -1
    if '"' not in page[at:plain] and "'" not in page[at:plain]:
        return plain + 1
    passed: list[int] = []
    while m := TAG_STOP.search(page, at):
        if m.group() == ">":
            return m.end()
        at = m.end()
        if m.start() in dead:
            break
        passed.append(m.start())
        at = page.find(m.group(), at) + 1
        if not at:
            break
    dead.update(passed)
    return plain + 1


def parse(page: str) -> list[Node]:
    """The nodes of a page; node 0 is the root, text nodes have the tag "". Linear in the page; nothing is refused."""
    nodes = [Node("html", -1)]
    open_ = Open(nodes)
    dead: set[int] = set()
    at, size = 0, len(page)
    lower = ""
    unclosed: set[str] = set()

    def put_text(raw: str) -> None:
        if raw:
            nodes.append(Node("", open_.stack[-1], text=html.unescape(raw) if "&" in raw else raw))

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put_text(page[at:])
            break
        nxt = page[lt + 1:lt + 2]
        if nxt == "!" or nxt == "?":
            put_text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4) if "-->" not in unclosed else -1
                if end < 0:
                    unclosed.add("-->")
                    end = page.find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    at = end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            put_text(page[at:lt + 1])
            at = lt + 1
            continue
        end = _tag_end(page, m.end(), dead)
        if end < 0:
            put_text(page[at:lt])
            break
        put_text(page[at:lt])
        tag, at = m.group().lower(), end
        if closing:
            open_.close((tag,), () if tag in SCOPE else SCOPE)
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            open_.close_paragraph()
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        elif tag == "body":
            open_.close(("head",), ())
        attrs = {}
        if end - m.end() > 1:
            for k, a, b, c in ATTRIBUTE.findall(page[m.end():end - 1]):
                value = a or b or c
                attrs.setdefault(k.lower(), html.unescape(value) if "&" in value else value)
        nodes.append(Node(tag, open_.stack[-1], attrs))
        if tag in VOID:
            continue
        if tag in RAW:
            if not lower:
                lower = page.lower() if page.isascii() else _ascii_lower(page)
            stop = -1 if tag in unclosed else lower.find(f"</{tag}", at)
            if stop < 0:
                unclosed.add(tag)
                at = size
            else:
                close = page.find(">", stop)
                at = size if close < 0 else close + 1
            continue
        open_.push(len(nodes) - 1)
    return nodes


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})
