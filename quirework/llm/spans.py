"""Long exact spans shared between records, by relative Lempel-Ziv parsing against an index of all records.

Index: every text is cut into reference blocks at content-defined anchors - the ``GRAM``-grams whose hash is the minimum of
``min_length - GRAM + 1`` neighbours - so that every span of ``min_length`` characters holds at least one anchor, and two texts that share the span
share the anchor. An anchor carries the hashes of the blocks before and behind it; only these, the text's class and the position are
shuffled, and anchors of a single text go no further.

Parsing: a text is factored greedily against each text that shares an anchor. A factor is a run of common anchors with equal blocks between
them; where the blocks before (behind) an anchor differ, the run begins (ends), and the factor is extended there character by
character. All that is needed for this is the ``SLICE`` of a text around an anchor at a factor's boundary: slices are cut from each text
once and joined with the boundaries, so no text is copied for its links. Factors of ``min_length`` characters or more become spans. A pair is
reported only if ``min_length`` characters of a slice of both texts are equal, one by one.

Equal texts are one class (by two hashes and the length), parsed once. An anchor shared by more than ``CROWD`` texts (boilerplate,
a hot group) is not turned into pairs: each of its texts emits the hashes of the at most ``min_length - GRAM + 1`` windows of
``min_length`` characters around it, and only texts with an equal window are paired (for ``coverage`` only with one other text): work in
proportion to the rows and to the pairs that are true, without a cap.

Defined results: null ids are left out; null and short texts (under ``min_length`` characters) have no spans; exact copies are pairs of each other; repeated ids are
one record; extra columns are ignored; an empty table gives an empty table; very long texts are parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.runtime import checkpointed, scan_bytes

GRAM = 100
CROWD = 64
BUCKETS = 1 << 18
BLOCK = 4096
SALTS, SAMPLE, MOST_HOT = 256, 100, 10_000  # see _hot
TASK_BYTES, MOST_TASKS = 8 << 20, 100_000  # of compressed files, for which there is a task of the anchors' exchange at least: they take several times as much
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    """The first ``n`` powers of a base; kept, and made anew for longer texts only."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.empty(max(n, 4096) * 5 // 4, np.uint64)
        with np.errstate(over="ignore"):
            kept[0] = 1
            kept[1:] = np.uint64(base)
            np.multiply.accumulate(kept, out=kept)
        _POWERS[base] = kept
    return kept[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


class Hashes:
    """64-bit hashes of any parts of a text, by differences of a polynomial prefix sum; equal parts have equal hashes wherever they stand."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(codes)
        self.total = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((codes + np.uint64(0x1F123BB5)) * _powers(self.n), out=self.total[1:])

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` characters."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mixed((self.total[width:] - self.total[:-width]) * _powers(self.n - width + 1, _INVERSE))

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.total[end] - self.total[start]) * _powers(self.n + 1, _INVERSE)[start] + (end - start).astype(np.uint64))


def window_hashes(text: str, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` characters."""
    return Hashes(text).windows(width)


def anchors(text: str, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text: the leftmost minimum of every ``min_length - GRAM + 1`` gram hashes."""
    return _anchors(window_hashes(text, GRAM), min_length)


def _anchors(h: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    w = min_length - GRAM + 1
    if len(h) < w:
        return np.zeros(0, np.int64), h[:0]
    pad = (-len(h)) % w
    rows = np.concatenate([h, np.full(pad, _MASK, np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[: len(h) - w + 1], before[w - 1 : len(h)])
    # a gram is an anchor if it is the minimum of a window that holds it; equal grams within a window are all kept
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    values = least[start]
    at = []
    for i, s in enumerate(start):
        end = (start[i + 1] if i + 1 < len(start) else len(least)) - 1 + w
        at.append(s + np.flatnonzero(h[s:end] == values[i]))
    at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
    return at, h[at]


def common(a: str, b: str) -> int:
    """Number of characters that two texts have in common from their beginnings."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))  # the first ``low`` agree
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _meetings(rows: DataFrame) -> DataFrame:
    """(ca, cb, pa, pb, first, last, sure) of the pairs of classes, smaller first, that share an anchor: whether a factor begins, ends there, and surely is long enough."""
    a = rows.select("h", F.col("c").alias("ca"), F.col("p").alias("pa"), F.col("u").alias("ua"), F.col("v").alias("va"), F.col("w").alias("wa"))
    b = rows.select("h", F.col("c").alias("cb"), F.col("p").alias("pb"), F.col("u").alias("ub"), F.col("v").alias("vb"), F.col("w").alias("wb"))
    return a.join(b, "h").where("ca < cb").select("ca", "cb", "pa", "pb", (F.col("ua") != F.col("ub")).alias("first"), (F.col("va") != F.col("vb")).alias("last"), (F.col("wa") == F.col("wb")).alias("sure"))


class SharedSpans:
    """The operator over a table with an id and a text: ``classes``, ``spans`` between classes, ``pairs`` and ``coverage``."""

    def __init__(self, frame: DataFrame, key: str, text: str, min_length: int = 200):
        if min_length <= GRAM:
            raise ValueError(f"min_length must be over {GRAM}")
        self.min_length = min_length
        long = frame.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull() & (F.char_length("text") >= min_length))
        self.texts = long.withColumn("c", F.concat_ws(":", F.hex(F.xxhash64("text")), F.hex(F.hash("text")), F.char_length("text").cast("string")))
        #: (id, c): the class of every record; copies have one class
        self.members = self.texts.select("id", "c").distinct()
        self._index: tuple[bool, DataFrame, DataFrame | None] | None = None

    def anchors(self, ends: bool = True, hot: tuple[int, ...] = (), texts: DataFrame | None = None) -> DataFrame:
        """(h, c, p, u, v, w, z): anchors of all texts; u and v are hashes of the blocks before and behind one, w of the ``min_length`` characters from it on.

        Without ``ends``, where only beginnings of factors are wanted, v is 0. z spreads the anchors whose
        hashes are in ``hot``, by the class; it is -1 for all others.
        """
        least = self.min_length

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[int] = set()
            for batch in batches:
                hs, cs, ps, us, vs, ws, ns = [], [], [], [], [], [], []
                for c, text in zip(batch["c"], batch["text"]):
                    if c in seen:  # a copy: a large group of copies sends its anchors once a task
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    hashes = Hashes(text)
                    at, h = _anchors(hashes.windows(GRAM), least)
                    between = hashes.parts(at[:-1], at[1:] + GRAM).view(np.int64)
                    # before the first and behind the last anchor no block is equal to another text's: a class's own number
                    own = np.array([c], np.int64)
                    hs.append(h.view(np.int64))
                    ps.append(at)
                    us.append(np.concatenate([own, between]))
                    vs.append(np.concatenate([between, own]) if ends else np.zeros(len(at), np.int64))
                    wide = np.full(len(at), c, np.int64)
                    fits = at + least <= hashes.n
                    wide[fits] = hashes.parts(at[fits], at[fits] + least).view(np.int64)
                    ws.append(wide)
                    cs.append(c)
                    ns.append(len(at))
                if cs:
                    h, c = np.concatenate(hs), np.repeat(np.array(cs, np.int64), ns)
                    z = np.where(np.isin(h, np.array(hot, np.int64)), c & (SALTS - 1), -1) if hot else np.full(len(h), -1)
                    yield pd.DataFrame({"h": h, "c": c, "p": np.concatenate(ps).astype(np.int32), "u": np.concatenate(us), "v": np.concatenate(vs), "w": np.concatenate(ws), "z": z.astype(np.int32)})

        short = (self.texts if texts is None else texts).select(F.expr("struct(xxhash64(c) AS k)").alias("s"), "text").select(F.col("s.k").alias("c"), "text")
        return short.mapInPandas(run, "h long, c long, p int, u long, v long, w long, z int")

    def _hot(self) -> tuple[int, ...]:
        """Hashes of anchors that surely are in more than ``CROWD`` classes, at most ``MOST_HOT`` of them.

        They are told from the anchors of every ``SAMPLE``-th class; this decides how anchors are spread over tasks, nothing else.
        """
        some = self.anchors(texts=self.texts.where(F.pmod(F.xxhash64("c"), F.lit(SAMPLE)) == 0)).select("h", "c").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
        return tuple(r.h for r in some.orderBy(F.desc("n"), "h").limit(MOST_HOT).collect())

    def _shared(self, ends: bool) -> tuple[DataFrame, DataFrame | None]:
        """Anchors that several classes have, with ``crowded``; and (h, c, p): windows of ``min_length`` characters around crowded ones that several classes have, or None."""
        if self._index is None or ends and not self._index[0]:
            self._index = (ends, *self._build(ends))
        return self._index[1:]

    def _build(self, ends: bool) -> tuple[DataFrame, DataFrame | None]:
        least = self.min_length
        # one exchange for the count and the join: the count reads all columns (the last test always holds). An anchor of very many texts is spread
        # over SALTS tasks; it is known to be shared and crowded, so its count doesn't need to be whole
        parts = max(int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-scan_bytes(self.texts) // TASK_BYTES)))
        found = self.anchors(ends, self._hot()).repartition(parts, "h", "z")
        counted = found.groupBy("h", "z").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("n"), *(F.max(x).alias(x) for x in "puvw"))
        shared = counted.where("(a <> b OR z >= 0) AND p >= 0 AND u IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL")
        rows = checkpointed(found.join(shared.select("h", "z", ((F.col("n") > CROWD) | (F.col("z") >= 0)).alias("crowded")), ["h", "z"]).distinct().drop("z"))
        if rows.where("crowded").isEmpty():
            return rows, None
        crowds = rows.where("crowded").groupBy("c").agg(F.collect_set("p").alias("ps"))  # at most the anchors of one text

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for c, text, ps in zip(batch["c"], batch["text"], batch["ps"]):
                    h = window_hashes(text, least)
                    starts = np.unique(np.concatenate([np.arange(max(0, p - (least - GRAM)), min(p, len(h) - 1) + 1) for p in ps]))
                    if len(starts):
                        yield pd.DataFrame({"h": h[starts].view(np.int64), "c": c, "p": starts.astype(np.int32)})

        every = self._some(crowds).join(crowds, "c").mapInPandas(windows, "h long, c long, p int")
        equal = every.groupBy("h").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("h")
        return rows, checkpointed(every.join(equal, "h").select("h", "c", "p"))

    def _slices(self, hits: DataFrame) -> DataFrame:
        """``hits`` (ca, cb, pa, pb, ahead, ...) with left and right: how many characters, compared one by one, agree before and from the two places on.

        At most ``min_length - GRAM`` characters are looked at before a place and ``min_length`` from it on, which is all that decides whether a
        common span of ``min_length`` characters holds it. Where ``ahead`` is set, only those from it on are wanted, and left is 0.
        """
        least = self.min_length
        before = least - GRAM
        wanted = hits.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("pa").alias("p"), "ahead"), F.struct(F.col("cb").alias("c"), F.col("pb").alias("p"), "ahead"))).alias("x")).groupBy("x.c").agg(F.collect_set(F.struct("x.p", "x.ahead")).alias("ps"))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for c, text, ps in zip(batch["c"], batch["text"], batch["ps"]):
                    for place in ps:
                        p, ahead = int(place["p"]), bool(place["ahead"])
                        out.append((c, p, ahead, "" if ahead else text[max(0, p - before) : p][::-1], text[p : p + least]))
                yield pd.DataFrame(out, columns=["c", "p", "ahead", "l", "r"])

        @F.pandas_udf("int")
        def agree(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([common(x, y) for x, y in zip(a, b)], dtype="int32")

        slices = self._some(wanted).join(wanted, "c").mapInPandas(cut, "c long, p int, ahead boolean, l string, r string")
        a = slices.select(F.col("c").alias("ca"), F.col("p").alias("pa"), "ahead", F.col("l").alias("la"), F.col("r").alias("ra"))
        b = slices.select(F.col("c").alias("cb"), F.col("p").alias("pb"), "ahead", F.col("l").alias("lb"), F.col("r").alias("rb"))
        return hits.join(a, ["ca", "pa", "ahead"]).join(b, ["cb", "pb", "ahead"]).select(*hits.columns, agree("la", "lb").alias("left"), agree("ra", "rb").alias("right"))

    def links(self) -> DataFrame:
        """(ca, cb): pairs of different classes, ca < cb, with a common span."""
        rows, windows = self._shared(ends=False)
        met = _meetings(rows.where("NOT crowded")).where("first").select("ca", "cb", "pa", "pb", "sure")
        if windows is not None:
            first = windows.groupBy("h", "c").agg(F.min("p").alias("p"))
            other = first.select("h", F.col("c").alias("cb"), F.col("p").alias("pb"))
            met = met.unionByName(first.select("h", F.col("c").alias("ca"), F.col("p").alias("pa")).join(other, "h").where("ca < cb").select("ca", "cb", "pa", "pb", F.lit(True).alias("sure")))
        # of a pair's factors one that is long by its hash is enough; a pair without has all compared
        place = F.struct("pa", "pb")
        each = met.groupBy("ca", "cb").agg(F.min(F.when(F.col("sure"), place)).alias("one"), F.collect_set(F.when(~F.col("sure"), place)).alias("all"))
        hits = each.select("ca", "cb", F.explode(F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.col("all"))).alias("x"), F.col("one").isNotNull().alias("ahead")).select("ca", "cb", "x.pa", "x.pb", "ahead")
        return self._slices(checkpointed(hits)).where(F.col("left") + F.col("right") >= self.min_length).select("ca", "cb").distinct()

    def spans(self) -> DataFrame:
        """(c, start, end, other): parts of the classes' texts of at least ``min_length`` characters that another class's text has too, each of them in full.

        Of crowded anchors each part is told with one other class; there parts can overlap each other.
        """
        rows, windows = self._shared(ends=True)
        if windows is not None:  # a factor is taken apart at crowded anchors, whose surroundings the windows tell
            order = Window.partitionBy("c").orderBy("p")
            apart = lambda near, block: F.when(F.coalesce(near, F.lit(False)), F.col("c")).otherwise(F.col(block))
            rows = rows.select("h", "c", "p", apart(F.lag("crowded").over(order), "u").alias("u"), apart(F.lead("crowded").over(order), "v").alias("v"), "w", "crowded")
        met = _meetings(rows.where("NOT crowded")).where("first OR last").select("ca", "cb", "pa", "pb", "first", "last")
        if windows is not None:
            ends = windows.groupBy("h").agg(F.min(F.struct("c", "p")).alias("x"), F.max(F.struct("c", "p")).alias("y"))
            crowd = windows.join(ends, "h").withColumn("o", F.when(F.col("c") == F.col("x.c"), F.col("y")).otherwise(F.col("x")))
            small = F.col("c") < F.col("o.c")
            met = met.unionByName(crowd.select(
                F.least("c", "o.c").alias("ca"), F.greatest("c", "o.c").alias("cb"), F.when(small, F.col("p")).otherwise(F.col("o.p")).alias("pa"),
                F.when(small, F.col("o.p")).otherwise(F.col("p")).alias("pb"), F.lit(True).alias("first"), F.lit(True).alias("last"),
            ).distinct())
        near = self._slices(checkpointed(met.withColumn("ahead", F.lit(False))))
        # on a diagonal of a pair, boundaries alternate: where one begins only, the next one ends the factor
        diagonal = Window.partitionBy("ca", "cb", F.col("pa") - F.col("pb")).orderBy("pa", F.col("first").desc())
        ended = near.withColumn("end", F.when(F.col("last"), F.col("pa") + F.col("right")).otherwise(F.lead(F.col("pa") + F.col("right")).over(diagonal))).where("first AND end IS NOT NULL")
        full = ended.select("ca", "cb", (F.col("pa") - F.col("left")).alias("sa"), (F.col("pb") - F.col("left")).alias("sb"), (F.col("end") - F.col("pa") + F.col("left")).alias("n")).where(F.col("n") >= self.min_length)
        sides = F.array(F.struct(F.col("ca").alias("c"), F.col("sa").alias("start"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("c"), F.col("sb").alias("start"), F.col("ca").alias("other")))
        return full.select("n", F.explode(sides).alias("x")).select("x.c", "x.start", (F.col("x.start") + F.col("n")).alias("end"), "x.other")

    def _some(self, classes: DataFrame) -> DataFrame:
        """(c, text) of the classes that occur in a table, one row each.

        Texts are reduced by a broadcast of at most ``BUCKETS`` bucket numbers before they are shuffled.
        """
        bucket = F.pmod("c", F.lit(BUCKETS))
        wanted = classes.select("c").distinct()
        texts = self.texts.select(F.xxhash64("c").alias("c"), "text")
        near = texts.join(F.broadcast(wanted.select(bucket.alias("__b")).distinct()), bucket == F.col("__b"), "left_semi")
        return near.join(wanted, "c", "left_semi").dropDuplicates(["c"])

    def _ids(self) -> DataFrame:
        return self.members.select("id", F.xxhash64("c").alias("c"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: records that share a span, copies included, one row per pair."""
        links = self.links()
        ids = self._ids()
        many = ids.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("ca"), F.col("c").alias("cb"))
        both = links.unionByName(many)
        a, b = ids.select(F.col("id").alias("x"), F.col("c").alias("ca")), ids.select(F.col("id").alias("y"), F.col("c").alias("cb"))
        each = both.join(a, "ca").join(b, "cb").where((F.col("ca") != F.col("cb")) | (F.col("x") < F.col("y")))
        return each.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def coverage(self) -> DataFrame:
        """(id, class_id, n_copies, n_links, shared_chars): one row per record of at least ``min_length`` characters.

        ``class_id`` is the smallest id of the record's class, ``n_links`` the number of other classes it shares a span with,
        ``shared_chars`` how many of its characters also stand in another record (all of them where it has a copy).
        """
        # parts are cut at multiples of BLOCK and told once, so that a text with any number of links is merged in bounded pieces
        block = F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}")))
        cut = self.spans().select("c", "start", "end").distinct().select("c", block.alias("block"), "start", "end")
        cut = cut.select("c", "block", F.greatest("start", F.col("block") * BLOCK).alias("s"), F.least("end", (F.col("block") + 1) * BLOCK).alias("e")).distinct()
        done = F.max("e").over(Window.partitionBy("c", "block").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
        covered = cut.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(done, F.col("s"))))).groupBy("c").agg(F.sum("new").cast("bigint").alias("covered"))
        links = self.links().select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
        merged = covered.join(links, "c", "full")
        ids = self.members.select("id", F.xxhash64("c").alias("c"), F.element_at(F.split("c", ":"), -1).cast("bigint").alias("n_chars"))
        classes = ids.groupBy("c").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
        each = ids.join(classes, "c").join(merged, "c", "left")
        return each.select(
            "id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_chars", F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars")
        )
