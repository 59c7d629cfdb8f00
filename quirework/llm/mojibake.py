"""Garbled text from wrong character encoding: finding the damaged spans and restoring the original text.

A hidden Markov model labels the characters of a text: one clean state and one state per encoding pair (bytes of ``right`` read as
``wrong``; also UTF-8 read wrongly twice, and the replacement character for what is lost). A state emits a unit of observed
characters with the probability that a trigram model of clean text gives to what its inverse transform makes of them; the
clean state emits the observed characters themselves. ASCII means the same in every pair, so a run of ASCII has the
same emission everywhere and is collapsed; the Viterbi path over the runs of a line labels the rest, and each
labelled span gets its state's inverse transform.

The trigram model is counted over the whole corpus (``train``): Python workers count the distinct tokens of their partition, Spark sums
them, and tokens that some pair turns into a more frequent token of the corpus are left out, whatever the partitions are; only the
model - trigrams seen at least ``min_share`` of all, a number bounded by 1 / ``min_share`` - reaches the driver. ``label`` then reads
each text once; a line whose runs don't together reach the cost of entering a state can't have a better path than the clean one, and costs a
dictionary look-up per run.

Defined results: null, empty and pure ASCII texts -> no span; very long texts are labelled line by line; U+FFFD is garbled
and not restorable (left in place); repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.runtime import checkpointed

LOST = "�"
#: wrong readings of UTF-8 bytes, and (right, wrong) pairs of single-byte encodings
UTF8_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
SINGLE_BYTE = (
    ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("cp1254", "cp1252"),
    ("iso8859_5", "cp1252"), ("cp866", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp1251", "mac_roman"),
)
ENTER_UTF8, ENTER_SINGLE, STAY, INNER = 4.0, 9.0, 0.05, 2.0
#: paths this far behind the best can't win any more (more than any later transition costs)
BEAM = 60.0


@lru_cache(maxsize=None)
def char_to_byte(encoding: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes it leaves undefined read as the control character of that number."""
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if encoding == "cp1252":  # also read as ISO 8859-1
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def byte_to_char(encoding: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            pass
    return out


def _utf8_unit(text: str, at: int, table: dict[str, int]) -> tuple[str, int] | None:
    """(decoded character, length) of the multi-byte sequence that begins at ``at`` under a wrong reading."""
    lead = table.get(text[at])
    if lead is None or not 0xC2 <= lead <= 0xF4:
        return None
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    tail = [table.get(c) for c in text[at + 1 : at + size]]
    if len(tail) < size - 1 or any(b is None or not 0x80 <= b <= 0xBF for b in tail):
        return None
    try:
        return bytes([lead, *tail]).decode("utf-8"), size
    except UnicodeDecodeError:
        return None


class State:
    """One encoding pair: ``unit(text, at)`` -> (restored characters, observed length) or None."""

    def __init__(self, name: str, wrong: str, right: str = "utf-8", twice: bool = False):
        self.name, self.twice, self.utf8 = name, twice, right == "utf-8"
        self.table = char_to_byte(wrong)
        self.back = None if self.utf8 else {c: byte_to_char(right)[b] for c, b in self.table.items() if b in byte_to_char(right)}
        self.enter = ENTER_UTF8 if self.utf8 else ENTER_SINGLE

    def unit(self, text: str, at: int) -> tuple[str, int] | None:
        if not self.utf8:
            c = self.back.get(text[at])
            return (c, 1) if c is not None else None
        first = _utf8_unit(text, at, self.table)
        if not first or not self.twice:
            return first
        inner, i = first[0], at + first[1]
        while len(inner) < 4:
            got = _utf8_unit(inner, 0, self.table)
            if got and got[1] == len(inner):
                return got[0], i - at
            more = _utf8_unit(text, i, self.table) if i < len(text) else None
            if not more:
                return None
            inner, i = inner + more[0], i + more[1]
        got = _utf8_unit(inner, 0, self.table)
        return (got[0], i - at) if got and got[1] == len(inner) else None


@lru_cache(maxsize=1)
def states() -> tuple[State, ...]:
    return (
        State("utf8-cp1252 twice", "cp1252", twice=True),
        *(State(f"utf8-{w}", w) for w in UTF8_AS),
        *(State(f"{r}-{w}", w, r) for r, w in SINGLE_BYTE),
    )


#: signs that also stand in clean text beside garbled letters
_SIGNS = frozenset("“”„«»–—…’‘•\xa0\u3000\u2003")
#: signs that any text may hold, however rare they were in training
_SYMBOLS = frozenset("¡¢£¤¥§©«®°±²³¶·¹»¼½¾¿×÷№€™†‡…–—“”„‘’•") | {chr(c) for c in range(0x2500, 0x25A0)}
_NONE: frozenset = frozenset()


@lru_cache(maxsize=1)
def _emitters() -> tuple[dict[str, list[int]], dict[str, frozenset]]:
    """For each character, the UTF-8 states in which it can begin a unit, and the single-byte states that can emit it."""
    leads: dict[str, list[int]] = {}
    singles: dict[str, set] = {}
    for k, state in enumerate(states()):
        for c, b in state.table.items():
            if state.utf8 and 0xC2 <= b <= 0xF4:
                leads.setdefault(c, []).append(k)
            elif not state.utf8 and c in state.back:
                singles.setdefault(c, set()).add(k)
    return leads, {c: frozenset(ks) for c, ks in singles.items()}


#: what nearly every text garbled from UTF-8 has: lead bytes of common scripts before a continuation, or entities of them
_HINT = re.compile("[ÃÂâÐÑÎÏÅÄ][^\x00-\x7f]|[├╨╤╬ð√‚¬РС][^\x00-\x7fа-яёА-Яії\\s“”’…»]|&(?:Atilde|Acirc|acirc|ETH|Ntilde|Icirc|Iuml|Aring|Auml);")
_RUN = re.compile(r"[^\x00-\x7f]+")
_SPACES = frozenset("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_MARKS = "“”„«»–—…’‘•.,;:!?\"'()"
_ENTITY = re.compile(r"&[A-Za-z]{2,8};")


@lru_cache(maxsize=1)
def _lead_pattern() -> re.Pattern:
    """Any two- to four-character sequence that decodes as UTF-8 under one of the wrong readings."""
    forms = []
    for wrong in UTF8_AS:
        of = {b: re.escape(c) for c, b in char_to_byte(wrong).items()}
        both = {}
        for c, b in char_to_byte(wrong).items():
            both.setdefault(b, []).append(re.escape(c))
        tail = "[" + "".join(x for b in range(0x80, 0xC0) for x in both.get(b, [])) + "]"
        for low, high, n in ((0xC2, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF5, 3)):
            lead = "".join(of[b] for b in range(low, high) if b in of)
            if lead:
                forms.append(f"[{lead}]{tail}{{{n}}}")
    return re.compile("|".join(forms))


def _decodings(token: str) -> list[str] | None:
    """What the UTF-8 pairs make of a token, also without signs at its ends; None if it is surely garbled (lost, or plain ASCII under a pair)."""
    if LOST in token:
        return None
    found: set[str] = set()
    if _lead_pattern().search(token):
        for state in states():
            if state.utf8:
                out, i = [], 0
                while i < len(token):
                    u = None if token[i].isascii() else state.unit(token, i)
                    out.append(u[0] if u else token[i])
                    i += u[1] if u else 1
                text = "".join(out)
                if text != token:
                    if text.isascii():
                        return None
                    found |= {text, text.strip(_MARKS)}
    return sorted(found - {token})


#: "à" whose second character, a no-break space, was since made a plain space
_WORN = re.compile("Ã (?= |[.,;:!?]|$)")


def unescaped(token: str) -> str:
    """Named entities of Latin characters as characters (garbled text is at times stored with them)."""
    return html.unescape(token) if _ENTITY.search(token) else token


def grams(token: str) -> Iterator[str]:
    """Trigrams of a folded token, padded, that touch a character beyond ASCII."""
    padded = f"^^{token.lower()}$"
    for i in range(len(padded) - 2):
        g = padded[i : i + 3]
        if not g.isascii():
            yield g


def train(texts: DataFrame, column: str = "text", min_share: float = 1e-7) -> dict[str, int]:
    """Trigram counts of clean text over the whole corpus (``texts`` has one text per row)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text is not None and not text.isascii():
                    tokens.update(t for t in text.split() if not t.isascii())
            if len(tokens) > 300_000:  # partial counts; Spark sums them
                yield pd.DataFrame({"token": list(tokens), "n": list(tokens.values())})
                tokens = Counter()
        yield pd.DataFrame({"token": list(tokens), "n": list(tokens.values())})

    @F.pandas_udf("array<string>")
    def decodings(token: pd.Series) -> pd.Series:
        return pd.Series([_decodings(t) for t in token])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: Counter = Counter()
            for token, n in zip(batch["token"], batch["n"]):
                for g in grams(token):
                    out[g] += n
            yield pd.DataFrame({"gram": list(out), "n": list(out.values())})

    tokens = texts.select(F.col(column).alias("text")).mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = checkpointed(tokens.withColumn("forms", decodings.asNondeterministic()("token")))
    # a token is a garbled copy of a more frequent one that some pair turns it into
    better = tokens.select(F.col("token").alias("form"), F.col("n").alias("m"))
    copies = tokens.where("size(forms) > 0").select("token", "n", F.explode("forms").alias("form")).join(better, "form").where("m > n").select("token")
    clean = tokens.where("forms IS NOT NULL").join(copies, "token", "left_anti").select("token", "n")
    grams_ = checkpointed(clean.mapInPandas(split, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams_.agg(F.sum("n")).first()[0] or 0
    return {r[0]: r[1] for r in grams_.where(F.col("n") >= min_share * total).collect()}


def plain(text: str) -> str:
    """A quick reading for statistics: the text decoded by the UTF-8 pair that explains the most of it, or only its garbled passages where that isn't much.

    No probabilities are involved; use ``Model.restore`` where the text itself matters.
    """
    if text.isascii() and "&" not in text or not _HINT.search(text):
        return text
    text = unescaped(text)
    runs = Counter(_RUN.findall(text))
    likely = Counter({run: n for run, n in runs.items() if _HINT.match(run)})
    # a pair that explains much of the text decodes all of it; else the best one for the runs that look garbled decodes those of them that it fits
    for much, some in ((True, runs), (False, likely)):
        best, most = None, 0
        for state in states():
            if state.utf8:
                got = sum(n for run, n in some.items() if state.unit(run, 0))
                if got > most:
                    best, most = state, got
        if best is not None and (not much or most >= 0.3 * sum(runs.values())):
            break
    if best is None:
        return text

    def decode(m: re.Match) -> str:
        run, out, i = m.group(), [], 0
        if not much and run not in likely:
            return run
        while i < len(run):
            u = best.unit(run, i)
            if not (u or much or run[i] in _SIGNS):
                return run  # clean text beside the garbled one
            out.append(u[0] if u else run[i])
            i += u[1] if u else 1
        return "".join(out)

    return _RUN.sub(decode, text)


class Model:
    """Interpolated trigram model of clean text and the Viterbi labelling that uses it."""

    def __init__(self, counts: dict[str, int]):
        self.tri = counts
        self.bi: Counter = Counter()
        self.ctx: Counter = Counter()
        self.ctx1: Counter = Counter()
        self.uni: Counter = Counter()
        for g, n in counts.items():
            self.ctx[g[:2]] += n
            self.bi[g[1:]] += n
            self.ctx1[g[1]] += n
            self.uni[g[2]] += n
        self.total = sum(counts.values()) or 1
        self.alpha = max(3.0, 1e-4 * self.total)
        self.better: dict[tuple, tuple] = {}
        self.scores: dict[tuple, tuple] = {}
        self.logs: dict[str, float] = {}

    def log(self, gram: str) -> float:
        """log P(third character | first two)."""
        got = self.logs.get(gram)
        if got is None:
            if gram[2] in _SPACES:
                got = -2.5
            elif gram[0] in _SPACES or gram[1] in _SPACES:
                got = self.log("^^" + gram[2] if gram[1] in _SPACES else "^" + gram[1:])
            elif gram.isascii():
                got = -3.0
            else:
                one = (self.uni.get(gram[2], 0) + 0.5) / (self.total + 5e4) if not gram[2].isascii() else 0.03
                two = (self.bi.get(gram[1:], 0) + self.alpha * one) / (self.ctx1.get(gram[1], 0) + self.alpha)
                got = math.log((self.tri.get(gram, 0) + self.alpha * two) / (self.ctx.get(gram[:2], 0) + self.alpha))
            if gram[2] in _SYMBOLS:
                got = max(got, -5.0)
            self.logs[gram] = got
        return got

    def span(self, left: str, middle: str, right: str) -> float:
        text = f"{left}{middle}{right}".lower()
        if len(text) != len(left) + len(middle) + len(right):
            text = f"{left}{middle}{right}"
        return sum(self.log(text[i - 2 : i + 1]) for i in range(2, len(text)))

    def run(self, left: str, run: str, right: str) -> tuple[float, list[tuple[int, float, str, bool]]]:
        """Score of a run of non-ASCII characters as clean, and (state, score, restored, whole) of the states that can emit it."""
        key = (left, run, right)
        got = self.scores.get(key)
        if got is not None:
            return got
        clean = self.span(left, run, right)
        found = []
        leads, singles = _emitters()
        some = {k for c in run for k in leads.get(c, ())}
        every: frozenset | None = None
        for c in run:
            if c not in _SIGNS:
                every = singles.get(c, _NONE) if every is None else every & singles.get(c, _NONE)
        for k in sorted(some | (every or _NONE)):
            best = self._inside(states()[k], left, run, right)
            if best is not None:
                found.append((k, *best))
        got = (clean, found)
        if len(self.scores) > 200_000:
            self.scores.clear()
        self.scores[key] = got
        return got

    def _inside(self, state: State, left: str, run: str, right: str) -> tuple[float, str, bool] | None:
        """Best labelling of a run by one pair and the clean state together: (score, restored run, every unit garbled)."""
        whole, i, units = [], 0, 0
        clean_chars = 0
        while i < len(run):
            u = state.unit(run, i)
            if u:
                whole.append(u[0])
                i += u[1]
                units += 1
            elif state.utf8 or run[i] in "“”„«»–—…’‘•\xa0　 ":
                whole.append(run[i])
                i += 1
                clean_chars += 1
            else:
                return None
        if not units:
            return None
        text = "".join(whole)
        if text == run:
            return None
        return self.span(left, text, right) - (INNER if clean_chars else 0), text, clean_chars == 0

    def suspicious(self, line: str) -> bool:
        """Whether the runs of a line together favour some pair enough to enter its state; where not, no path beats the clean one.

        A path pays ``enter`` for each stretch in a state, so one that wins has a stretch whose runs gain more than that.
        """
        if LOST in line:
            return True
        text = unescaped(line) if "&" in line else line
        gains: dict[int, float] = {}
        for m in _RUN.finditer(text):
            for k, gain in self.gains(*_context(text, m)):
                gains[k] = gains.get(k, 0.0) + gain
        table = states()
        return any(gain >= table[k].enter for k, gain in gains.items())

    def gains(self, left: str, run: str, right: str) -> tuple[tuple[int, float], ...]:
        """(state, margin over the clean state) of the states that explain a run better than clean text does."""
        key = (left, run, right)
        got = self.better.get(key)
        if got is None:
            clean, found = self.run(*key)
            got = tuple((k, score - clean) for k, score, _, _ in found if score > clean)
            if len(self.better) > 200_000:
                self.better.clear()
            self.better[key] = got
        return got

    def label(self, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        """(restored line, labelled spans (start, end, state) of the line) by the Viterbi path over its runs."""
        text = unescaped(line) if "&" in line else line
        runs = list(_RUN.finditer(text))
        table = states()
        paths: dict[int, tuple[float, tuple | None]] = {-1: (0.0, None)}
        for m in runs:
            clean, found = self.run(*_context(text, m))
            top = max(paths, key=lambda j: paths[j][0] - (1.0 if j >= 0 else 0.0))
            following: dict[int, tuple[float, tuple]] = {}
            for k, (score, restored) in {-1: (clean, m.group()), **{k: (s, r) for k, s, r, _ in found}}.items():
                change = paths[top][0] - (1.0 if top >= 0 else 0.0) - (table[k].enter if k >= 0 else -0.5 if top >= 0 else 0.0)
                stay = paths[k][0] - STAY if k in paths else None
                if stay is not None and stay >= change:
                    following[k] = (stay + score, (paths[k][1], k, restored))
                else:
                    following[k] = (change + score, (paths[top][1], k, restored))
            best = max(p[0] for p in following.values())
            paths = {k: p for k, p in following.items() if p[0] > best - BEAM or k == -1}
        if not runs:
            return line, []
        labels = []
        step = max(paths.values(), key=lambda p: p[0])[1]
        while step is not None:
            labels.append(step[1:])
            step = step[0]
        labels.reverse()
        out, spans, at = [], [], 0
        for m, (k, restored) in zip(runs, labels):
            out.append(text[at : m.start()])
            if k >= 0:
                spans.append((m.start(), m.end(), table[k].name))
                out.append(restored)
            elif LOST in m.group():
                spans.append((m.start(), m.end(), "lost"))
                out.append(m.group())
            else:
                out.append(m.group())
            at = m.end()
        out.append(text[at:])
        if not any(s[2] != "lost" for s in spans):
            return line, spans
        new = "".join(out)
        if any(s[2].startswith("utf8-cp1252") for s in spans):
            new = _WORN.sub("à", new)
        return new, spans

    def restore(self, text: str | None) -> tuple[str | None, list[tuple[int, int, int, str]]]:
        """(restored text, spans (line, start, end, state)) of one field."""
        if text is None or (text.isascii() and "&" not in text):
            return text, []
        lines, spans = text.split("\n"), []
        for n, line in enumerate(lines):
            if line.isascii() and not ("&" in line and _ENTITY.search(line)) or not self.suspicious(line):
                continue
            lines[n], found = self.label(line)
            spans.extend((n, *s) for s in found)
        return "\n".join(lines), spans


def _context(text: str, m: re.Match) -> tuple[str, str, str]:
    left = text[max(0, m.start() - 2) : m.start()]
    cut = max(left.rfind(" "), left.rfind("\t"), left.rfind("\n"))
    left = "^^"[: 2 - (len(left) - cut - 1)] + left[cut + 1 :]
    right = text[m.end() : m.end() + 2].split(" ")[0].split("\t")[0]
    return left, m.group(), right if len(right) == 2 else right + "$"


_MODELS: dict[int, Model] = {}


def model_of(counts: dict[str, int]) -> Model:
    """One Model per set of counts and Python worker, so that its caches serve all tasks of the worker."""
    key = hash(frozenset(counts.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(counts)
    return _MODELS[key]


_RESULT = "restored string, n_spans int, n_lost int, states array<string>"


def restored(text: Column, model: dict[str, int]) -> Column:
    """STRUCT<restored, n_spans, n_lost, states> of a text column; n_spans is 0 and restored null where nothing is garbled."""

    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hmm = model_of(model)
        for batch in batches:
            out = []
            for text in batch:
                new, spans = hmm.restore(text)
                lost = sum(s[3] == "lost" for s in spans)
                out.append((new if spans else None, len(spans), lost, sorted({s[3] for s in spans})))
            yield pd.DataFrame(out, columns=["restored", "n_spans", "n_lost", "states"])

    return run(text)
