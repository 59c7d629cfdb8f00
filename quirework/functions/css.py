"""Style sheets: rules, declarations and selectors as plain data."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"(?s)/\*.*?(?:\*/|$)")
_BRACE = re.compile(r"[{}]")
_SELECTOR = re.compile(r"(?P<tag>[^.#]*)(?P<rest>(?:[.#][^.#]*)*)")


def without_comments(css: str) -> str:
    return _COMMENT.sub("", css)


def declarations(block: str) -> dict[str, str]:
    """Name -> value of a block: divided at ``;`` outside quotes, at the first ``:``; both sides must be there, the last of equal names wins."""
    parts, quote, start = [], None, 0
    for i, c in enumerate(block):
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ";":
            parts.append(block[start:i])
            start = i + 1
    parts.append(block[start:])
    out: dict[str, str] = {}
    for part in parts:
        name, colon, value = part.partition(":")
        name, value = name.strip(), value.strip()
        if colon and name and value:
            out.pop(name, None)
            out[name] = value
    return out


def _kind(prelude: str) -> tuple[str, str]:
    """(kind, what stands behind the keyword) of a block or statement that begins with ``@``."""
    for word, kind in (("@media", "media"), ("@supports", "supports"), ("@font-face", "font-face"), ("@page", "page"), ("@import", "import"), ("@namespace", "namespace")):
        if prelude.startswith(word):
            return kind, prelude[len(word) :].strip()
    return "other", prelude[1:].strip()


def rules(css: str) -> list[dict]:
    """Rules in source order as rows: rule, parent (row number or None), kind, selectors, query, name, declarations, content.

    Media and supports blocks are rows whose inner rules name them as parent. Braces are counted without regard to quotes;
    a block that isn't closed runs to the end.
    """
    out: list[dict] = []

    def add(parent, kind, **fields) -> int:
        out.append({"rule": len(out), "parent": parent, "kind": kind, "selectors": None, "query": None, "name": None, "declarations": {}, "content": None} | fields)
        return len(out) - 1

    def read(text: str, parent: int | None) -> None:
        at = 0
        while at < len(text):
            while at < len(text) and text[at].isspace():
                at += 1
            if at >= len(text):
                return
            brace, semicolon = text.find("{", at), text.find(";", at)
            if text[at] == "@" and semicolon >= 0 and (brace < 0 or semicolon < brace):
                statement = text[at:semicolon].strip()
                kind, rest = _kind(statement)
                kind = kind if kind in ("import", "namespace") else "other"
                add(parent, kind, name=statement[1:].strip() if kind == "other" else None, content="" if kind == "other" else rest)
                at = semicolon + 1
                continue
            if brace < 0:
                return
            depth, end = 1, len(text)
            for m in _BRACE.finditer(text, brace + 1):
                depth += 1 if m.group() == "{" else -1
                if not depth:
                    end = m.end()
                    break
            body = text[brace + 1 : end - 1 if depth == 0 else end]
            prelude = text[at:brace].strip()
            at = end
            if not prelude:
                continue
            if not prelude.startswith("@"):
                add(parent, "style", selectors=prelude, declarations=declarations(body))
                continue
            kind, rest = _kind(prelude)
            if kind in ("media", "supports"):
                read(body, add(parent, kind, query=rest))
            elif kind in ("font-face", "page"):
                add(parent, kind, query=rest or None, declarations=declarations(body))
            else:
                add(parent, "other", name=prelude[1:].strip(), content=body.strip())

    read(without_comments(css), None)
    return out


def simple_selectors(group: str) -> list[tuple[str | None, list[str], list[str]]]:
    """(tag or None for any, classes, ids) of each selector of a group that can match at all.

    Only a tag with classes and ids is known; selectors with combinators, attributes or pseudo parts match nothing and are left
    out. An empty selector matches every element.
    """
    out = []
    for selector in group.split(","):
        selector = selector.strip()
        if re.search(r"[\s>+~:\[\]]", selector):
            continue
        m = _SELECTOR.fullmatch(selector)
        parts = re.findall(r"([.#])([^.#]*)", m["rest"])
        if any(not name for _, name in parts):
            continue
        tag = m["tag"]
        out.append((None if tag in ("", "*") else tag, [n for s, n in parts if s == "."], [n for s, n in parts if s == "#"]))
    return out


def cascade(nodes: list[list], sheet: list[dict]) -> dict[int, dict[str, str]]:
    """Styles of every element: all top-level style rules that match in source order, then the element's own ``style``."""
    matchers = [(simple_selectors(r["selectors"]), r["declarations"]) for r in sheet if r["kind"] == "style" and r["parent"] is None]
    out: dict[int, dict[str, str]] = {}
    for i, (_, kind, tag, attributes, _) in enumerate(nodes):
        if kind != "Element":
            continue
        classes, own_id = (attributes.get("class") or "").split(), attributes.get("id")
        styles: dict[str, str] = {}
        for selectors, block in matchers:
            if any((t is None or t == tag) and all(c in classes for c in cs) and all(x == own_id for x in ids) for t, cs, ids in selectors):
                styles.update(block)
        styles.update(declarations(attributes.get("style") or ""))
        out[i] = styles
    return out
