"""A small tolerant HTML tree: elements, attributes that matter, text, and its blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these kinds, if no barrier lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend"}
BARRIER = frozenset({"table", "td", "th", "button", "article", "section", "div", "body", "html", "aside", "main", "nav", "form"})

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")


class Node:
    """An element; ``items`` holds its texts and child elements in order."""

    __slots__ = ("tag", "attributes", "items", "parent", "place")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.items, self.parent = tag, attributes, [], parent
        self.place: int | None = None

    def children(self) -> Iterator[Node]:
        return (x for x in self.items if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed([x for x in node.items if isinstance(x, Node)]))


def _attributes(text: str) -> dict[str, str]:
    if "=" not in text and "hidden" not in text:
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def parse(html: str) -> Node:
    """The tree below an element ``#root``; never fails, whatever the markup."""
    root = Node("#root", {}, None)
    top, at, size = root, 0, len(html)
    find = _TAG.search
    while at < size:
        m = find(html, at)
        if not m:
            top.items.append(html[at:])
            break
        if m.start() > at:
            top.items.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            top = _close(top, m[1].lower())
            continue
        name = m[2] or m[4]
        if not name:
            continue
        tag, rest = name.lower(), m[3] or m[5] or ""
        top = _make_room(top, tag)
        node = Node(tag, _attributes(rest) if rest else {}, top)
        top.items.append(node)
        if tag in VOID or (rest.endswith("/") and tag in RAW):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else size
        top = node
    return root


def _close(top: Node, tag: str) -> Node:
    """The element open after an end tag; one that closes nothing is passed over."""
    node, inline = top, tag not in BLOCK
    while node.parent is not None:
        if node.tag == tag:
            return node.parent
        if inline and node.tag in BLOCK:
            return top
        if tag == "p" and node.tag in BARRIER or tag == "li" and node.tag in ("ul", "ol"):
            return top
        node = node.parent
    return top


def _make_room(top: Node, tag: str) -> Node:
    """Elements that a start tag ends without an end tag."""
    kinds, barriers = ENDS.get(tag, ((), ()))
    if tag in NO_P:
        top = _ended(top, {"p"}, BARRIER)
    if tag[0] == "h" and tag in ("h1", "h2", "h3", "h4", "h5", "h6") and top.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        top = top.parent
    return _ended(top, kinds, barriers) if kinds else top


def _ended(top: Node, kinds, barriers) -> Node:
    node, outer = top, top
    while node.parent is not None and node.tag not in barriers:
        if node.tag in kinds:
            outer = node.parent
        node = node.parent
    return outer


def blocks(root: Node) -> Iterator[tuple[Node, str, int]]:
    """``element, text, length of linked text`` of every block with text, in page order.

    White space becomes one space, character references are decoded, and a
    block ends where another begins.
    """
    parts: list[str] = []
    linked = 0

    def text() -> str:
        joined = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        return joined

    # (element, position among its items, whether inside a link)
    stack: list[list] = [[root, 0, False]]
    owner = root
    while stack:
        frame = stack[-1]
        node, k, link = frame
        if k < len(node.items):
            frame[1] += 1
            item = node.items[k]
            if isinstance(item, str):
                parts.append(item)
                linked += len(item) if link else 0
            elif item.tag == "br":
                parts.append(" ")
            elif item.tag in RAW or item.tag in VOID and item.tag != "hr":
                continue
            else:
                if item.tag in BLOCK:
                    if parts and (told := text()):
                        yield owner, told, linked
                    linked, owner = 0, item
                stack.append([item, 0, link or item.tag == "a"])
            continue
        stack.pop()
        if node.tag in BLOCK or node is root:
            if parts and (told := text()):
                yield owner, told, linked
            linked = 0
            owner = next((f[0] for f in reversed(stack) if f[0].tag in BLOCK or f[0] is root), root)
