"""Language of documents and of the segments of mixed ones, by compression with per-language zstandard dictionaries.

A block of words belongs to the language whose raw-content dictionary compresses it best; a block that no dictionary compresses,
or whose margin over the second language is narrow, is rejected. Every block is first compressed with the dictionary of the language
that most of its words suggest and with one dictionary of all the others together; only where the first isn't clearly smaller are
all languages tried one by one. A block's result depends on its words only. Neighbouring blocks of one language are a
segment; its ends, and its length in words, are then settled word by word with the languages' vocabularies, which are
built from the same sample as the dictionaries. A stretch that is too short to decide a block is found by its words: wherever
words of another language's vocabulary that the text's main language lacks stand close together, that language is aligned too, and its
stretches of ``STRETCH`` words or more are compressed on their own.

Training (``train``) uses at most ``SAMPLE_TEXTS`` texts per language, chosen by hash among texts labelled with that one language,
and drops those whose frequent words contradict the label; frequent words seed languages without a labelled text. Detection
reads whole texts. Texts garbled from UTF-8 are decoded first.

Defined results: null or empty text, or text without words -> no segment; text that is no language -> no segment; extra columns are
ignored; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.llm.mojibake import plain

SAMPLE_TEXTS = 100
DICTIONARY_BYTES = 32_000
SHARED_BYTES = 8_000
LEVEL = 1
BLOCK = 16
#: a block is clearly of a language if all others together need this many times its size
CLEAR = 1.2
#: a language is accepted for a block if it saves this share of the second one's size, and compresses to this share of the block
MARGIN, WORTH = 0.06, 0.92
#: a stretch inside a block of another language counts from this many words, of which ``stretches`` wants 0.3 beyond the main language's vocabulary
STRETCH = 12
DENSE, REACH = 4, 36  # so it has this many such words within this many (names between them included)

# Languages that labels are most often written for - two-letter code, three-letter codes (ISO 639-2 and 639-3), English and native names.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français", "es": "spa spanish castilian español castellano",
    "it": "ita italian italiano", "pt": "por portuguese português", "nl": "nld dut dutch flemish nederlands vlaams", "da": "dan danish dansk",
    "sv": "swe swedish svenska", "pl": "pol polish polski", "cs": "ces cze czech čeština český česky", "ru": "rus russian русский",
    "uk": "ukr ukrainian українська", "el": "ell gre greek ελληνικά ελληνική", "tr": "tur turkish türkçe",
}
# The other bibliographic codes of ISO 639-2, which differ from the three-letter codes that the JVM knows.
BIBLIOGRAPHIC = {
    "sq": "alb", "hy": "arm", "eu": "baq", "bo": "tib", "my": "bur", "zh": "chi", "cy": "wel", "fa": "per", "ka": "geo", "is": "ice", "mk": "mac", "mi": "mao", "ms": "may", "ro": "rum", "sk": "slo",
}


def language_names() -> dict[str, str]:
    """Name or code in lower case -> two-letter code, of every language of ISO 639-1: codes and names come from the JVM's locale data."""
    names = {name: code for code, own in LANGUAGES.items() for name in (code, *own.split())}
    locale = SparkSession.active()._jvm.java.util.Locale
    codes = [c for c in locale.getISOLanguages() if len(c) == 2]
    for code in codes:
        names.setdefault(code, code)
    for code in codes:
        of = locale.forLanguageTag(code)
        for name in (of.getISO3Language(), BIBLIOGRAPHIC.get(code), of.getDisplayLanguage(locale.ENGLISH), of.getDisplayLanguage(of)):
            if name:
                names.setdefault(name.lower(), code)
    return names


_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")


def declared(label: Column) -> Column:
    """The two-letter code that a label declares (a code, a tag that starts with one, or a name), else null. Runs in the JVM."""
    whole = F.lower(F.trim(label))
    first = F.regexp_extract(whole, r"^(\p{L}{2,3})(?:[-_].*)?$", 1)
    table = F.create_map(*(F.lit(x) for pair in language_names().items() for x in pair))
    return F.coalesce(F.try_element_at(table, whole), F.try_element_at(table, first))


def sample(labelled: DataFrame, texts: DataFrame, key: str, text: str, label: str, size: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """(label, text) of at most ``size`` texts per label, chosen by the hash of the key.

    ``labelled`` has key, text and label; only its keys and labels are shuffled and ranked, the chosen ones fetched from ``texts``.
    """
    keys = labelled.where(F.col(label).isNotNull() & (F.char_length(text) > 200)).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("k"), F.col(label).alias("l")).dropDuplicates(["k"])
    # the group of one label may be most of the table: keep the smallest hashes of each task's share before ranking
    shares = keys.withColumn("part", F.pmod(F.hash("k"), F.lit(64)))
    few = shares.withColumn("r", F.row_number().over(Window.partitionBy("l", "part").orderBy("h"))).where(F.col("r") <= size)
    chosen = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= size).select("k", F.col("l").alias("label"))
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").dropDuplicates(["k"]).orderBy("k").collect()
    return [(r.label, r.t) for r in rows]


class Detector:
    """Dictionaries and vocabularies of the languages; plain data, so that it travels to the workers."""

    def __init__(self, texts: Iterable[tuple[str, str]], frequent: Iterable[tuple[str, str]] = ()):
        common: dict[str, set[str]] = defaultdict(set)
        seeds: dict[str, list[str]] = defaultdict(list)
        for lang, word in frequent:
            common[word.lower()].add(lang)
            seeds[lang].append(word.lower())
        words: dict[str, list[list[str]]] = defaultdict(list)
        for lang, text in texts:
            own = [w.lower() for w in _WORD.findall(plain(text))]
            votes = Counter(x for w in own for x in common.get(w, ()) if len(common[w]) == 1)
            total = sum(votes.values())
            if common and (total < 10 or votes[lang] < 0.9 * total):
                continue  # a wrong label, a mixed text or no prose
            words[lang].append(own)
        counts = {lang: Counter(w for own in words[lang] for w in own) for lang in {*words, *seeds}}
        for lang, own in seeds.items():
            counts[lang].update({w: 2 for w in own})
        totals = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
        share: dict[str, float] = defaultdict(float)
        for lang, c in counts.items():
            for w, n in c.items():
                share[w] = max(share[w], n / totals[lang])
        #: languages in order; the vocabulary as word -> bit set of the languages that have it
        self.languages = sorted(counts)
        self.bits: dict[str, int] = defaultdict(int)
        for k, lang in enumerate(self.languages):
            for w, n in counts[lang].items():
                if n > 1 and n / totals[lang] > 0.05 * share[w]:
                    self.bits[w] |= 1 << k
        self.bits = dict(self.bits)
        if len(self.languages) > 62:
            raise ValueError("more than 62 languages")
        self.content = {lang: " ".join([*seeds[lang], *(" ".join(own) for own in words[lang])]).encode()[-DICTIONARY_BYTES:] for lang in self.languages}
        self._made: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _compressors(self) -> dict:
        if self._made is None:
            def of(content: bytes) -> zstandard.ZstdCompressor:
                shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)

            rest = {lang: b" ".join(c[-SHARED_BYTES:] for x, c in self.content.items() if x != lang) for lang in self.content}
            self._made = {lang: (of(c).compress, of(rest[lang]).compress if rest[lang] else None) for lang, c in self.content.items()}
        return self._made

    def best(self, block: bytes) -> tuple[str | None, float]:
        """(language or None, confidence) of a block by all dictionaries."""
        sizes = sorted((len(own(block)), lang) for lang, (own, _) in self._compressors().items())
        if not sizes:
            return None, 0.0
        second = sizes[1][0] if len(sizes) > 1 else len(block)
        saved = (second - sizes[0][0]) / max(1, second)
        return sizes[0][1] if saved >= MARGIN and sizes[0][0] <= WORTH * len(block) else None, saved

    def clear(self, block: bytes, lang: str) -> float | None:
        """Confidence that a block is of a language: what its dictionary saves beside one of all the others together; None if that isn't clear."""
        own, rest = self._compressors()[lang]
        size = len(own(block))
        if size > WORTH * len(block):
            return None
        other = len(rest(block)) if rest else len(block)
        return (other - size) / other if other >= CLEAR * size else None

    def blocks(self, joined: str, ends: np.ndarray, has: np.ndarray) -> list[tuple[str | None, float]]:
        """(language, confidence) of every block of ``BLOCK`` words; the last block takes a short rest.

        ``joined`` are the words with spaces between, ``ends`` their ends in it, ``has`` tells for each word the languages that have it.
        """
        starts = np.arange(0, max(1, len(ends) - BLOCK // 2 + 1), BLOCK)
        guesses = np.add.reduceat(has, starts, axis=0).argmax(1).tolist()
        cuts = [0, *(ends[starts[1:] - 1] + 1).tolist(), len(joined) + 1]
        out: list[tuple[str | None, float]] = []
        for k, guess in enumerate(guesses):
            block, lang = joined[cuts[k] : cuts[k + 1] - 1].encode(), self.languages[guess]
            sure = self.clear(block, lang)
            out.append(self.best(block) if sure is None else (lang, sure))
        return out

    def foreign(self, has: np.ndarray, known: np.ndarray, home: int) -> dict[str, list[tuple[int, int]]]:
        """For each language, (start, end) of the parts of a text where its words that the main language lacks stand close together."""
        at = np.flatnonzero(known & ~has[:, home])
        out: dict[str, list[tuple[int, int]]] = {}
        if len(at) < DENSE:
            return out
        some = has[at]
        for x in np.flatnonzero(some.sum(0) >= DENSE).tolist():
            own = at[some[:, x]]
            first, last = own[: len(own) - DENSE + 1], own[DENSE - 1 :]
            close = last - first < REACH
            parts: list[tuple[int, int]] = []
            for a, b in zip(first[close].tolist(), last[close].tolist()):
                if parts and a <= parts[-1][1]:
                    parts[-1] = (parts[-1][0], b + 1)
                else:
                    parts.append((a, b + 1))
            if parts:
                out[self.languages[x]] = parts
        return out

    def stretches(self, has: np.ndarray, known: np.ndarray, free: np.ndarray, lang: int, home: int) -> list[tuple[int, int, int]]:
        """(start, end, number of words) of the runs of words of a language; unknown words and names don't end a run.

        ``known`` are the words that some language has, ``free`` those that count in any (unknown words that are no names).
        """
        own = has[:, lang] & known
        at = np.flatnonzero(own)
        if not len(at):
            return []
        run = np.cumsum(known & ~own)[at]
        counted = np.cumsum(own | free)
        cut = np.flatnonzero(run[1:] != run[:-1])
        ends = [*cut.tolist(), len(at) - 1]
        out = []
        special = np.cumsum(~has[at, home]) if home != lang else None
        begin = 0
        for end in ends:
            first, last = int(at[begin]), int(at[end])
            n = int(counted[last] - counted[first]) + 1
            own_words = end - begin + 1 if special is None else int(special[end] - (special[begin - 1] if begin else 0))
            if own_words >= max(2, 0.3 * n):
                out.append((first, last + 1, n))
            begin = end + 1
        return out

    def segments(self, text: str | None) -> list[tuple[int, int, int, str, float]]:
        """(start word, end word, words of the language, language, confidence) of a text's segments, in order."""
        if not text or not self.content:
            return []
        words = _WORD.findall(plain(text))
        if not words:
            return []
        joined = " ".join(words).lower()
        low = joined.split(" ")
        if len(low) != len(words):
            low = [w.lower().replace(" ", "") for w in words]
            joined = " ".join(low)
        count = len(low)
        ends = np.append(np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32), len(joined))
        bits = np.fromiter(map(self.bits.get, low, repeat(0)), np.int64, count)
        has = (bits[:, None] >> np.arange(len(self.languages)) & 1).astype(bool)
        known = bits != 0
        blocks = self.blocks(joined, ends, has)
        sure: dict[str, list[float]] = defaultdict(list)
        near: dict[str, set[int]] = defaultdict(set)
        for i, (lang, saved) in enumerate(blocks):
            if lang:
                near[lang].add(i)
                sure[lang].append(saved)
        if not near:
            return []
        home = self.languages.index(max(near, key=lambda x: (len(near[x]), x)))
        foreign = self.foreign(has, known, home)
        free = ~known
        alone = np.empty(count, bool)  # words of one letter
        alone[0], alone[1:] = ends[0] == 1, ends[1:] - ends[:-1] == 2
        for i in np.flatnonzero(free | alone).tolist():
            w = words[i]
            if w[0].isupper() and (len(w) == 1 or w[1:].islower()):
                free[i] = False  # a name: in no language if it is one letter
                if len(w) == 1:
                    known[i] = False
        out = []
        for lang in [*near, *(x for x in foreign if x not in near)]:
            at, parts = near.get(lang, ()), foreign.get(lang, ())
            confidence = sum(sure[lang]) / len(sure[lang]) if sure[lang] else 0.0
            for a, b, n in self.stretches(has, known, free, self.languages.index(lang), home):
                if n >= 3 and any(i in at for i in range(a // BLOCK, (b - 1) // BLOCK + 1)):
                    out.append((a, b, n, lang, confidence))
                elif n >= STRETCH and any(x < b and a < y for x, y in parts):
                    found, saved = self.best(" ".join(low[a:b]).encode())
                    if found == lang:
                        out.append((a, b, n, lang, saved))
        out.sort(key=lambda s: (-s[2], s[0], s[3]))
        kept: list[tuple[int, int, int, str, float]] = []
        for a, b, n, lang, confidence in out:  # a word belongs to one segment: longer ones first, others lose the words at their ends that both languages have
            start, end = a, b
            for x, y, *_ in kept:
                if x <= a < y:
                    start = max(start, y)
                if x < b <= y:
                    end = min(end, x)
            if any(x < end and start < y for x, y, *_ in kept):
                continue
            if (start, end) == (a, b):
                kept.append((a, b, n, lang, confidence))
            elif start < end and self.best(" ".join(low[start:end]).encode())[0] == lang:
                part = slice(start, end)
                kept.extend((start + i, start + j, m, lang, confidence) for i, j, m in self.stretches(has[part], known[part], free[part], self.languages.index(lang), home) if m >= 3)
        return sorted(kept)


def segments(text: Column, detector: Detector) -> Column:
    """ARRAY<STRUCT<start_word, end_word, n_words, lang, confidence>> of a text."""

    @F.pandas_udf("array<struct<start_word int, end_word int, n_words int, lang string, confidence double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"start_word": a, "end_word": b, "n_words": n, "lang": x, "confidence": float(c)} for a, b, n, x, c in detector.segments(t)] for t in batch])

    return run.asNondeterministic()(text)  # else a filter on the result, also one that explode implies, would have each text read twice
