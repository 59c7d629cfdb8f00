"""Filling fixed-capacity containers by patterns fitted with non-negative least squares.

Sizes are counted into ``BINS`` classes of the capacity, rounded up, so that a pattern of classes that fits holds any items of these
classes. Small items are first joined to bundles of at most a quarter of the capacity. All full patterns of few units (at most ``FEW``)
of the classes that occur are enumerated - their number is bounded by ``BINS``, not by the data - and their repeat counts fitted to the histogram
by non-negative least squares (Lawson-Hanson). Full patterns of more units enter the same fit by pricing: the one that
the residual asks for most is found by an exact knapsack over all of them, until none improves the fit. The counts are rounded down; the same
is done with patterns one class short of full, then with every maximal one, and the rest is covered by patterns taken greedily
from the remaining counts, until every count is zero. Only the histogram (at most ``BINS`` numbers a capacity) reaches the driver; which
item goes where follows from the item's number within its class, which is computed by shards with summed offsets, never by
sorting a class in one task. Several capacities are packed in one plan, with the capacity as a column.

An item larger than the capacity is divided into full containers and a rest; no other item is ever divided.

Defined results: null sizes and sizes below 1 are left out (there is nothing to place); equal sizes are told apart by id; repeated ids
are one item; extra columns are ignored; an empty table or no capacity gives an empty table; a capacity below 1, a repeated name or more than
``MOST_TARGETS`` capacities are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.runtime import checkpointed

BINS = 64
SMALL = 8  # items of at most BINS / SMALL classes are bundled
BUNDLE = 4  # bundles hold at most capacity / BUNDLE
SHARD_ROWS = 50_000
FEW = 4  # units of the patterns that are enumerated
MOST_TARGETS = 1_000


def few_patterns(bins: list[int], least: int, units: int = 4) -> list[tuple[int, ...]]:
    """All multisets of at most ``units`` of the given classes that fill ``least`` to BINS of the classes' sum, largest class first."""
    bins, out = sorted(set(bins), reverse=True), []

    def extend(prefix: tuple[int, ...], room: int, at: int) -> None:
        if prefix and BINS - room >= least:
            out.append(prefix)
        if len(prefix) < units:
            for i in range(at, len(bins)):
                if bins[i] <= room:
                    extend((*prefix, bins[i]), room - bins[i], i)

    extend((), BINS, 0)
    return out


def priced(values: np.ndarray, bins: list[int], least: int) -> tuple[float, tuple[int, ...]]:
    """(worth, pattern) of the multiset of the classes ``bins`` filling ``least`` to BINS whose classes' ``values`` sum to the most; an exact knapsack."""
    best, last = np.full(BINS + 1, -np.inf), np.zeros(BINS + 1, int)
    best[0] = 0.0
    for room in range(1, BINS + 1):
        for k in bins:
            if k <= room and best[room - k] + values[k] > best[room]:
                best[room], last[room] = best[room - k] + values[k], k
    at = least + int(best[least:].argmax())
    worth, pattern = float(best[at]), []
    while at > 0 and np.isfinite(worth):
        pattern.append(int(last[at]))
        at -= last[at]
    return worth, tuple(sorted(pattern, reverse=True))


def _settle(a: np.ndarray, b: np.ndarray, x: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inner loop of Lawson-Hanson: least squares over the active columns, those that would turn negative leaving."""
    while active.any():
        z = np.zeros(len(x))
        z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
        bad = active & (z <= 1e-12)
        if not bad.any():
            return z, active
        ratio = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
        x = x + ratio * (z - x)
        active = active & (x > 1e-12)
        x[~active] = 0
    return np.zeros(len(x)), active


def nnls(a: np.ndarray, b: np.ndarray, price=None, steps: int = 10_000) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Lawson-Hanson non-negative least squares; an error if ``steps`` aren't enough.

    ``price`` maps a residual to (worth, column) of the best column that is not in ``a``, or None: columns are then generated as they
    are needed, and (solution, matrix with them) is returned.
    """
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-8 * max(1.0, abs(b).max(initial=0.0))
    norm = np.inf
    for _ in range(steps):
        r = b - a @ x
        w = a.T @ r
        w[active] = -np.inf
        j = int(w.argmax()) if len(w) else -1
        most = w[j] if j >= 0 else -np.inf
        new = price(r) if price else None
        if new is not None and new[0] > most + small and new[0] > small:
            a, x, active = np.column_stack([a, new[1]]), np.append(x, 0.0), np.append(active, False)
            j, most = a.shape[1] - 1, new[0]
        now = float(r @ r)
        if most <= small or now >= norm * (1 - 1e-13):  # solved, or no step that the numbers can tell
            return (x, a) if price else x
        norm = now
        active[j] = True
        x, active = _settle(a, b, x, active)
    raise RuntimeError(f"non-negative least squares did not settle in {steps} steps")


def column(pattern: tuple[int, ...]) -> np.ndarray:
    return np.bincount(pattern, minlength=BINS + 1).astype(float)


def plan(histogram: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every counted item exactly once."""
    left = np.zeros(BINS + 1, np.int64)
    for k, n in histogram.items():
        left[k] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need = np.bincount(pattern, minlength=BINS + 1)
        times = min([times, *(left[k] // need[k] for k in set(pattern))])
        if times > 0:
            left[:] -= need * times
            out.append((pattern, int(times)))

    for least in (BINS, BINS - 1, 0):
        bins = [k for k in range(BINS, 0, -1) if left[k]]
        if not bins:
            break
        least = least or BINS - min(bins) + 1  # maximal: no further class fits
        found = few_patterns(bins, least, FEW)
        matrix = np.array([column(p) for p in found]).T if found else np.zeros((BINS + 1, 0))

        def price(r: np.ndarray, bins: list[int] = bins, least: int = least) -> tuple[float, np.ndarray] | None:
            worth, pattern = priced(r, bins, least)
            return (worth, column(pattern)) if len(pattern) > FEW else None

        x, matrix = nnls(matrix, left.astype(float), price)
        columns = matrix.T.astype(int)
        full = columns @ np.arange(BINS + 1)
        for j in np.argsort(-full, kind="stable"):
            if x[j] >= 1:
                take(tuple(int(k) for k in range(BINS, 0, -1) for _ in range(columns[j, k])), int(x[j]))
    while left.any():
        room, pattern = BINS, []
        have = left.copy()
        for k in range(BINS, 0, -1):
            while k <= room and have[k]:
                pattern.append(k)
                have[k] -= 1
                room -= k
        take(tuple(pattern), int(left.max()))
    return out


def _numbered(units: DataFrame) -> DataFrame:
    """Units with ``rank``: their number within (``pack``, ``bin``) from 0, by shards and offsets of shards."""
    own = units.withColumn("r", F.row_number().over(Window.partitionBy("pack", "bin", "shard").orderBy("unit")) - 1)
    counts = units.groupBy("pack", "bin", "shard").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("pack", "bin").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("pack", "bin", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    return own.join(offsets, ["pack", "bin", "shard"]).select("pack", "unit", "bin", (F.col("offset") + F.col("r")).alias("rank"))


def bundle(part: pd.DataFrame) -> pd.DataFrame:
    """Best fit of a shard's small items, largest first, into bundles of at most a quarter of the capacity."""
    if not len(part):
        return pd.DataFrame({"pack": [], "id": [], "piece": [], "n": [], "unit": []})
    most, shard = int(part["cap"].iloc[0]) // BUNDLE, part["shard"].iloc[0]
    part = part.sort_values(["n", "id"], ascending=[False, True], kind="stable")
    rooms: list[list[int]] = [[] for _ in range(most + 1)]  # open bundles by free room
    count, names = 0, []
    occupied = 0  # bit set of rooms with an open bundle
    for n in part["n"]:
        fit = occupied >> int(n)
        if fit:
            room = int(n) + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                occupied &= ~(1 << room)
        else:
            room, b, count = most, count, count + 1
        names.append(b)
        rooms[room - int(n)].append(b)
        occupied |= 1 << (room - int(n))
    return pd.DataFrame({"pack": part["pack"], "id": part["id"], "piece": part["piece"], "n": part["n"], "unit": [f"b{shard}-{b}" for b in names]})


def pack_all(items: DataFrame, key: str, size: str, capacities: list[tuple[str, int]]) -> DataFrame:
    """(pack_name STRING, container BIGINT, key, piece INT, n BIGINT): ``items`` in containers of every named capacity, in one plan.

    ``piece`` counts the parts of a divided item from 0 and is 0 for every other item; ``n`` is the part's size. ``items`` is read
    twice and should be cheap to read (a table or a checkpoint).
    """
    names, sizes_ = [n for n, _ in capacities], [int(c) for _, c in capacities]
    if min(sizes_, default=1) < 1:
        raise ValueError("capacity must be at least 1")
    if len(names) > MOST_TARGETS or len(set(names)) < len(names):
        raise ValueError(f"names of capacities must be different and at most {MOST_TARGETS}")
    spark = items.sparkSession
    sizes = items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{size}`").cast("bigint").alias("n")).where("n >= 1").dropDuplicates(["id"])
    id_type = dict(sizes.dtypes)["id"]
    if not capacities:
        return spark.createDataFrame([], f"pack_name string, container bigint, `{key}` {id_type}, piece int, n bigint")
    shards = max(1, -(-sizes.count() // SHARD_ROWS))
    targets = F.array(*(F.struct(F.lit(i).alias("pack"), F.lit(c).cast("bigint").alias("cap")) for i, c in enumerate(sizes_)))
    each = sizes.select("id", "n", F.explode(targets).alias("t")).select("t.pack", "t.cap", "id", "n", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    rest = each.select("pack", "cap", "id", F.expr("CAST(n div cap AS INT)").alias("piece"), F.expr("n % cap").alias("n"), "shard").where("n > 0").withColumn("bin", F.ceil(F.col("n") * BINS / F.col("cap")).cast("int"))
    is_small = (F.col("bin") <= max(1, BINS // SMALL)) & (F.col("n") <= F.expr(f"cap div {BUNDLE}"))
    bundled = rest.where(is_small).groupBy("pack", "shard").applyInPandas(bundle, f"pack int, id {id_type}, piece int, n bigint, unit string")
    large = rest.where(~is_small).select("pack", "id", "piece", "n", F.concat_ws("-", F.lit("i"), F.col("id").cast("string")).alias("unit"))
    members = checkpointed(large.unionByName(bundled))
    cap = F.element_at(F.array(*map(F.lit, sizes_)), F.col("pack") + 1)
    units = members.groupBy("pack", "unit").agg(F.sum("n").alias("s"))
    units = checkpointed(units.select("pack", "unit", F.ceil(F.col("s") * BINS / cap).cast("int").alias("bin"), F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int").alias("shard")))
    histograms: list[dict[int, int]] = [{} for _ in names]
    for r in units.groupBy("pack", "bin").agg(F.count("*").alias("k")).collect():  # at most BINS rows a capacity
        histograms[r.pack][r.bin] = r.k
    slots, containers = [], []
    for i, histogram in enumerate(histograms):
        used, count = dict.fromkeys(histogram, 0), 0
        for pattern, times in plan(histogram):
            for k in sorted(set(pattern)):
                many = pattern.count(k)
                slots.append((i, k, used[k], used[k] + many * times, many, count))
                used[k] += many * times
            count += times
        containers.append(count)
    layout = spark.createDataFrame(slots, "pack int, bin int, low long, high long, each int, first long")
    placed = _numbered(units).join(F.broadcast(layout), ["pack", "bin"]).where("rank >= low AND rank < high").select("pack", "unit", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("container"))
    inside = members.join(placed, ["pack", "unit"]).select("pack", "container", "id", "piece", "n")
    # containers of divided items are numbered behind the others, by shards of items with summed offsets
    big = each.where("n >= cap").select("pack", "cap", "id", "shard", F.expr("n div cap").alias("k"))
    sums = big.groupBy("pack", "shard").agg(F.sum("k").alias("k"))
    sums = sums.select("pack", "shard", F.coalesce(F.sum("k").over(Window.partitionBy("pack").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    own = F.coalesce(F.sum("k").over(Window.partitionBy("pack", "shard").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.element_at(F.array(*map(F.lit, containers)), F.col("pack") + 1)
    whole = big.withColumn("before", own).join(sums, ["pack", "shard"]).select("pack", (first + F.col("offset") + F.col("before")).alias("start"), "id", "cap", F.explode(F.expr("sequence(0, CAST(k AS INT) - 1)")).alias("piece"))
    whole = whole.select("pack", (F.col("start") + F.col("piece")).alias("container"), "id", "piece", F.col("cap").alias("n"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("pack") + 1)
    return inside.unionByName(whole).select(name.alias("pack_name"), F.col("container").cast("bigint").alias("container"), F.col("id").alias(key), "piece", "n")


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(container BIGINT, key, piece INT, n BIGINT): ``pack_all`` for one capacity."""
    return pack_all(items, key, size, [("", capacity)]).drop("pack_name")
