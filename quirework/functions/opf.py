"""Container and package documents of e-books, read with an event parser. One document in, one plain structure out."""

from __future__ import annotations

from xml.parsers import expat

SCALARS = {"title": "title", "description": "description", "publisher": "publisher", "date": "publication_date", "rights": "rights"}
LISTS = {"creator": "authors", "language": "languages", "subject": "subjects", "identifier": "identifiers", "contributor": "contributors"}


class BookError(ValueError):
    """An error of a book's structure with a kind, carried as data by the operators."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _parse(data: bytes, start, text=None, end=None) -> None:
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = start
    if text:
        parser.CharacterDataHandler = text
    if end:
        parser.EndElementHandler = end
    parser.UseForeignDTD(True)  # external definitions are never fetched; unknown entities are left out
    parser.ExternalEntityRefHandler = lambda *_: 1
    try:
        parser.Parse(data, True)
    except expat.ExpatError as error:
        raise BookError("Xml", str(error)) from None


def parse_container(data: bytes) -> str:
    """Path of the package document: the last ``rootfile`` (exactly that name) that has one."""
    found: list[str] = []

    def start(name: str, attributes: dict) -> None:
        if name == "rootfile" and attributes.get("full-path") is not None:
            found.append(attributes["full-path"])

    _parse(data, start)
    if not found:
        raise BookError("InvalidFormat", "the container names no rootfile")
    return found[-1]


def parse_package(data: bytes) -> dict:
    """Metadata, manifest and spine of a package document.

    Element names match in any case, with the prefix ``dc`` or none. The last of several scalars wins, lists keep their order. Text
    of an element is taken whole, with entities decoded. Manifest rows keep their position; a cover image is the last item with
    the property, else the first cover ``meta``.
    """
    out: dict = {"version": None, **dict.fromkeys(SCALARS.values()), **{k: [] for k in LISTS.values()}, "spine": [], "manifest": []}
    state = {"metadata": 0, "field": None, "text": [], "by_property": None, "by_meta": None}

    def start(name: str, attributes: dict) -> None:
        low = name.lower()
        if low == "package":
            out["version"] = attributes.get("version", out["version"])
        elif low == "metadata":
            state["metadata"] += 1
        elif low == "item":
            item, href = attributes.get("id", ""), attributes.get("href", "")
            if item and href:
                properties = attributes.get("properties")
                out["manifest"].append((item, href, attributes.get("media-type", ""), properties))
                if properties and "cover-image" in properties:
                    state["by_property"] = item
        elif low == "itemref":
            if attributes.get("idref") is not None:
                out["spine"].append(attributes["idref"])
        elif low == "meta" and state["metadata"] and attributes.get("name") == "cover" and attributes.get("content") and not state["by_meta"]:
            state["by_meta"] = attributes["content"]
        if state["metadata"]:
            field = low.removeprefix("dc:")
            flush()
            state["field"] = field if field in SCALARS or field in LISTS else None

    def flush() -> None:
        value = "".join(state["text"]).strip()
        state["text"] = []
        if state["field"] and value:
            if state["field"] in SCALARS:
                out[SCALARS[state["field"]]] = value
            else:
                out[LISTS[state["field"]]].append(value)

    def text(data_: str) -> None:
        if state["metadata"] and state["field"]:
            state["text"].append(data_)

    def end(name: str) -> None:
        low = name.lower()
        if state["metadata"]:
            flush()
            state["field"] = None
        if low == "metadata":
            state["metadata"] -= 1

    _parse(data, start, text, end)
    out["cover_image_id"] = state["by_property"] or state["by_meta"]
    return out
