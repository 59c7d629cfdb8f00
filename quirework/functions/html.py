"""Tolerant reading of chapter markup into a flat list of nodes, and what is derived from it."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

#: elements that end a line of text, and elements without content
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 br li".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head meta link script style title".split())
KEPT_ATTRIBUTES = frozenset("alt title id class role lang dir".split())
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);")
_AMPERSAND = "\ufdd0"  # a noncharacter, which no text contains
_NAME = re.compile(r"[a-z][a-z0-9-]*")
_TAG = re.compile(r"<\s*([^\s/>]+)")


def decoded(text: str) -> str:
    """Entities that end with a semicolon as characters; others stay."""
    text = text.replace(_AMPERSAND, "&")
    return _ENTITY.sub(lambda m: entities.unescape(m.group()), text) if "&" in text else text


class _Reader(HTMLParser):
    """Nodes as [parent, kind, tag, attributes, content]; node 0 is the root. Unmatched end tags are ignored."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes: list[list] = [[None, "Element", "root", {}, None]]
        self.open = [0]
        self.text: list[str] = []

    def updatepos(self, i, j):
        return j  # lines aren't counted, nobody asks for positions

    def _flush(self) -> None:
        if self.text:
            raw = "".join(self.text)
            self.text = []
            parent = self.nodes[self.open[-1]]
            self.nodes.append([self.open[-1], "Text", None, None, raw.replace(_AMPERSAND, "&") if parent[2] in ("script", "style") else decoded(raw)])

    def handle_starttag(self, tag, attrs):
        if self.text:
            self._flush()
        raw = self.get_starttag_text() or ""
        name = _TAG.match(raw)
        own = name.group(1) if name else tag
        attributes: dict[str, str] = {}
        for key, value in attrs:
            attributes.setdefault(key, decoded(value) if value is not None else "")
        self.nodes.append([self.open[-1], "Element", own, attributes, None])
        if tag not in VOID and not raw.rstrip().endswith("/>"):
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.nodes[self.open[-1]][2].lower() == tag and self.open[-1] == len(self.nodes) - 1:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.text:
            self._flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]][2].lower() == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._flush()
        self.nodes.append([self.open[-1], "Comment", None, None, decoded(data)])


def parse(markup: str) -> list[list]:
    """Nodes of a document, in document order."""
    reader = _Reader()
    reader.feed(markup.replace("&", _AMPERSAND))  # so that the parser leaves references alone; they are decoded strictly here
    reader.close()
    reader._flush()
    return reader.nodes


def children(nodes: list[list]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for i, n in enumerate(nodes):
        if n[0] is not None:
            out[n[0]].append(i)
    return out


def text_of(nodes: list[list]) -> str:
    """Plain text: text nodes in order, a line feed behind every block element, lines trimmed and blank ones dropped."""
    below = children(nodes)
    parts: list[str] = []
    stack: list[tuple[int, bool]] = [(0, False)]
    while stack:
        i, leaving = stack.pop()
        _, kind, tag, _, content = nodes[i]
        if leaving:
            parts.append("\n")
        elif kind == "Text":
            parts.append(content)
        elif kind == "Element":
            if tag in BLOCKS:
                stack.append((i, True))
            stack.extend((c, False) for c in reversed(below[i]))
    return "\n".join(line for line in (x.strip() for x in "".join(parts).split("\n")) if line)


def title_of(nodes: list[list]) -> str | None:
    """First non-empty text node of the first h1, else h2, else title element that has one; else the first text anywhere."""
    below = children(nodes)

    def first_text(i: int) -> str | None:
        stack = [i]
        while stack:
            j = stack.pop()
            if nodes[j][1] == "Text" and nodes[j][4].strip():
                return nodes[j][4].strip()
            stack.extend(reversed(below[j]))
        return None

    for wanted in ("h1", "h2", "title"):
        for i, n in enumerate(nodes):
            if n[1] == "Element" and n[2].lower() == wanted and (found := first_text(i)):
                return found
    return first_text(0)


def to_tree(nodes: list[list], styles: dict[int, dict[str, str]] | None = None) -> dict:
    """The nodes as one nested structure with tagged unions: Element, Text and Comment."""
    made: list[dict] = []
    for i, (parent, kind, tag, attributes, content) in enumerate(nodes):
        node = {"type": kind, "tag": tag, "attrs": attributes, "styles": (styles or {}).get(i, {}), "children": []} if kind == "Element" else {"type": kind, "content": content}
        made.append(node)
        if parent is not None:
            made[parent]["children"].append(node)
    return made[0]


def from_tree(tree: dict) -> list[list]:
    """Inverse of ``to_tree``."""
    nodes: list[list] = []
    stack: list[tuple[dict, int | None]] = [(tree, None)]
    while stack:
        node, parent = stack.pop()
        element = node["type"] == "Element"
        nodes.append([parent, node["type"], node.get("tag") if element else None, node.get("attrs") if element else None, None if element else node.get("content")])
        at = len(nodes) - 1
        stack.extend((c, at) for c in reversed(node.get("children", ())))
    return nodes


def rendered(nodes: list[list], styles: dict[int, dict[str, str]] | None = None) -> str:
    """Safe markup: html and body unwrapped, hidden elements, comments, scripts and event attributes left out, styles written inline."""
    below, styles = children(nodes), styles or {}

    def write(i: int) -> str:
        _, kind, tag, attributes, content = nodes[i]
        if kind == "Text":
            return entities.escape(content, quote=False)
        if kind != "Element" or tag.lower() in HIDDEN:
            return ""
        inner = "".join(write(c) for c in below[i])
        low = tag.lower()
        if low in ("root", "html", "body"):
            return inner
        name = low if _NAME.fullmatch(low) else "div"
        keep = {k: v for k, v in (attributes or {}).items() if k in KEPT_ATTRIBUTES or k in ("href", "src") or k.startswith("aria-")}
        if own := styles.get(i):
            keep["style"] = "; ".join(f"{k}: {v}" for k, v in own.items())
        head = name + "".join(f' {k}="{entities.escape(v)}"' for k, v in keep.items())
        return f"<{head}>" if name in VOID else f"<{head}>{inner}</{name}>"

    return write(0)
