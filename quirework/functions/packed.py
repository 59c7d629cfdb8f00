"""Parsing expression grammar for single fields that hold several values.

    list      <- item (sep item)* end             sep of the first level, in order, that gives two values or more
    item      <- ws (quoted / bracketed / bare)? ws
    quoted    <- '"' ('""' / '\\' any / !'"' any)* '"' &(ws (sep / end))
    bracketed <- '[' item (sep item)+ ']' &(ws (sep / end))     its items stand in the list in its place
    bare      <- (term / '\\' any / !sep any)+     term: a known single value, longest first, at word boundaries

Alternatives are ordered and the parser backtracks: a quote that is not closed before a separator or the end is no
quoted item, the text is read as bare and flagged. Known terms may contain separators and are never divided.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# Separators by level; the first level that yields at least two values is the field's.
STRONG = re.compile(r"\s*[;|\t\n\r、；·•¦]\s*")
SLASH = re.compile(r"\s*/\s*")
COMMA = re.compile(r"\s*,\s*")
CONJUNCTION = re.compile(r"(?:\s*,)?\s+(?:and|with|und|et|y|e|og|och|en)\s+|(?:\s*,)?\s*&\s*")
COMMA_OR_CONJUNCTION = re.compile(rf"{CONJUNCTION.pattern}|\s*,\s*")
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}

# Words of names of organisations (also abbreviated); a name that has one is never divided at "and" or "&".
ORGANISATION_WORDS = frozenset(
    "press editions editions. eds eds. éditions publishers publisher publishing pubs publ publ. house hse hse. brothers bros bros. books bks "
    "bks. company co co. group grp grp. media verlag society soc soc. foundation found found. institute inst inst. library lib lib. "
    "collective coll coll. university univ univ. printing prtg prtg. studies college museum association committee office bureau".split()
)
NAME_SUFFIXES = frozenset("jr jr. sr sr. ii iii iv ph.d. phd md m.d. esq esq. ltd ltd. inc inc. llc gmbh co co.".split())


class Grammar:
    """The list grammar for one kind of field; ``terms`` are single values as written, ``people`` allows name lists."""

    def __init__(self, terms: Iterable[str] = (), people: bool = False):
        self.people = people
        self.terms = frozenset(t.strip().casefold() for t in terms if t and re.search(r"[;|/,·&]", t))
        firsts: dict[str, list[str]] = {}
        for term in sorted(self.terms, key=len, reverse=True):
            firsts.setdefault(term[0], []).append(term)
        self.by_first = firsts

    def _term(self, text: str, low: str, at: int) -> int:
        """Length of the longest known term at ``at``, 0 if there is none."""
        if at and (text[at - 1].isalnum()):
            return 0
        for term in self.by_first.get(low[at : at + 1], ()):
            if low.startswith(term, at):
                end = at + len(term)
                if end == len(text) or not text[end].isalnum():
                    return len(term)
        return 0

    def _quoted(self, text: str, at: int, sep: re.Pattern) -> tuple[str, int] | None:
        close = QUOTES.get(text[at])
        if not close:
            return None
        out, i = [], at + 1
        while i < len(text):
            c = text[i]
            if c == "\\" and i + 1 < len(text):
                out.append(text[i + 1])
                i += 2
            elif c == close:
                if c == '"' and text[i + 1 : i + 2] == '"':
                    out.append('"')
                    i += 2
                    continue
                rest = i + 1
                while rest < len(text) and text[rest] in "  ":
                    rest += 1
                if rest == len(text) or sep.match(text, i + 1):
                    return "".join(out), i + 1
                return None
            else:
                out.append(c)
                i += 1
        return None

    def _bracketed(self, text: str, at: int, sep: re.Pattern) -> tuple[list[str], list[bool], bool, int] | None:
        """Items of a bracketed list at ``at``, whether each was quoted, whether a quote was malformed, and the list's end; None if there is no list of two items or more."""
        close = text.find("]", at + 1)
        if text[at] != "[" or close < 0 or "[" in text[at + 1 : close]:
            return None
        rest = close + 1
        while rest < len(text) and text[rest].isspace() and not sep.match(text, rest):
            rest += 1
        if rest < len(text) and not sep.match(text, close + 1) and not sep.match(text, rest):
            return None
        values, quoted, malformed = self.split(text[at + 1 : close], sep)
        return (values, quoted, malformed, close + 1) if len(values) > 1 else None

    def _bare(self, text: str, low: str, at: int, sep: re.Pattern) -> tuple[str, int]:
        out, i = [], at
        while i < len(text):
            if known := self._term(text, low, i):
                out.append(text[i : i + known])
                i += known
                continue
            if text[i] == "\\" and i + 1 < len(text) and not text[i + 1].isalnum():
                out.append(text[i + 1])
                i += 2
                continue
            if sep.match(text, i):
                break
            out.append(text[i])
            i += 1
        return "".join(out), i

    def split(self, text: str, sep: re.Pattern) -> tuple[list[str], list[bool], bool]:
        """(values without empty ones, whether each was quoted, whether a quote was malformed) with one separator."""
        low = text.casefold()
        if len(low) != len(text):
            low = text.lower() if len(text.lower()) == len(text) else text
        values, quoted, malformed, i = [], [], False, 0
        while i <= len(text):
            while i < len(text) and text[i].isspace() and not sep.match(text, i):
                i += 1
            hit = self._quoted(text, i, sep) if i < len(text) else None
            inner = self._bracketed(text, i, sep) if not hit and i < len(text) else None
            if hit:
                value, i = hit
            elif inner:
                values += inner[0]
                quoted += inner[1]
                malformed |= inner[2]
                value, i = "", inner[3]
            else:
                start = i
                value, i = self._bare(text, low, i, sep)
                malformed |= text[start : start + 1] in QUOTES and bool(value)
            if value.strip():
                values.append(value.strip())
                quoted.append(bool(hit))
            while i < len(text) and text[i].isspace() and not sep.match(text, i):
                i += 1
            if i >= len(text):
                break
            m = sep.match(text, i)
            i = m.end() if m and m.end() > i else i + 1
        return values, quoted, malformed

    def parse(self, text: str | None) -> tuple[list[str], str]:
        """(the values in order, flag); one value or none means that the field is not packed.

        Flags: ``ok``, ``single``, ``empty`` and ``malformed_quote`` (a quote was opened and not closed; read as bare).
        """
        if text is None or not text.strip():
            return [], "empty"
        whole = text.strip()
        if len(whole) > 2 and whole[0] == "[" and whole[-1] == "]" and "[" not in whole[1:-1]:
            inner, flag = self.parse(whole[1:-1])
            if len(inner) > 1:
                return inner, flag
        for sep in (STRONG, SLASH):
            values, _, malformed = self.split(whole, sep)
            if len(values) > 1:
                return values, "malformed_quote" if malformed else "ok"
        if self.people:
            names = self._people(whole)
            if names:
                return names, "malformed_quote" if self.split(whole, COMMA_OR_CONJUNCTION)[2] else "ok"
        else:
            values, _, malformed = self.split(whole, COMMA)
            if len(values) > 1:
                return values, "malformed_quote" if malformed else "ok"
        values, _, malformed = self.split(whole, STRONG)
        return values, "malformed_quote" if malformed else "single" if values else "empty"

    def _people(self, text: str) -> list[str] | None:
        parts, quoted, _ = self.split(text, COMMA)
        if len(parts) > 1 and all(quoted):
            return parts
        if any(w in ORGANISATION_WORDS for w in re.split(r"[\s,]+", text.casefold())):
            return None
        full = [len([w for w in p.split() if len(w.rstrip(".")) > 1 and not w[0].islower()]) > 1 for p in parts]
        joined, _, _ = self.split(text, CONJUNCTION)
        if len(joined) > 1:
            if len(parts) > 1 and all("," in j for j in joined):  # Surname, Given & Surname, Given
                return joined
            names, _, _ = self.split(text, COMMA_OR_CONJUNCTION)
            if all(len(n.split()) > 1 for n in names):
                return names
            return None
        tail = len(parts) > 1 and parts[-1].casefold() in NAME_SUFFIXES
        if len(parts) > 1 and not tail and all(full):
            return parts
        if len(parts) > 3 and len(parts) % 2 == 0 and not any(full):  # Surname, Given, Surname, Given
            return [f"{a}, {b}" for a, b in zip(parts[::2], parts[1::2])]
        return None
