"""Mixed timestamp formats and time zones: one normal form per written date.

``normalise_dates`` parses each string once, in Arrow batches, with the zone and numeric date order of its group (a feed).
Where a group's zone is not given, ``estimate_zones`` finds it: every offset history of the zone database turns the group's local
timestamps into instants; an instant after the row's ingestion time, one that steps back against the group's sequence order, or
a wall time the zone skipped, is a violation. The history with the fewest violations wins, ties going to the smallest mean lag
before ingestion. Violations are counted in batches for all histories at once and summed over (group, history) with map-side partial
sums; the order within a group is taken from a range partitioning of the whole table, whose borders are compared in a second
small step, so a group of any size spreads over all tasks.

Defined results: null or blank text -> status ``empty``; approximate dates, ranges and words -> ``unparsed``; impossible dates and
times -> ``impossible``; local times without a zone -> ``no_zone``; repeated rows give repeated results; an empty table
gives an empty table. Input columns are kept; the new ones are ``normal_form`` and ``date_status`` (names can be changed).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.dates import local_time, parse_date, zone_of
from quirework.runtime import checkpointed

#: the years whose offset changes tell zones apart
FIRST_YEAR, LAST_YEAR = 1990, 2037
#: well-known cities, whose names stand for a history that several zones share, and win a tie; every history of the database is tried all the same
WELL_KNOWN = (
    "UTC Europe/London Europe/Berlin Europe/Athens Europe/Moscow Europe/Istanbul America/New_York America/Chicago America/Denver America/Los_Angeles America/Phoenix America/Mexico_City "
    "America/Bogota America/Sao_Paulo Asia/Tokyo Asia/Shanghai Asia/Singapore Asia/Kolkata Asia/Karachi Asia/Dubai Australia/Sydney Pacific/Auckland Africa/Lagos Africa/Cairo Africa/Johannesburg"
).split()


@lru_cache(maxsize=1024)
def _history_of(name: str) -> tuple[np.ndarray, np.ndarray]:
    """(instants of change, offsets from there on) of a zone in seconds, from FIRST_YEAR to LAST_YEAR."""
    zone, week = zone_of(name), 7 * 86400
    start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR + 1))

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())

    last = offset(start)
    changes = [(-(1 << 40), last)]
    for t in range(start, end, week):
        now = offset(t)
        if now != last:  # between two points of the grid; changes that cancel out within a week are not looked for
            low, high = t - week, t
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == last else (low, middle)
            changes.append((high, now))
            last = now
    return np.array([t for t, _ in changes], np.int64), np.array([o for _, o in changes], np.int64)


@lru_cache(maxsize=1)
def histories() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Zone name -> offset history, one name for each history of the zone database: a well-known one, else the first of a continent's cities, else the first."""
    regions = ("Africa/", "America/", "Antarctica/", "Asia/", "Atlantic/", "Australia/", "Europe/", "Indian/", "Pacific/")
    known = {name: k for k, name in enumerate(WELL_KNOWN)}
    found: dict[tuple, str] = {}
    for name in sorted(available_timezones() - {"localtime", "Factory"}, key=lambda n: (known.get(n, len(known)), not n.startswith(regions), n)):
        if zone_of(name) is not None:
            at, offsets = _history_of(name)
            found.setdefault((*at.tolist(), *offsets.tolist()), name)
    return {name: _history_of(name) for name in found.values()}


def same_history(a: str | None, b: str | None) -> bool:
    """Whether two zone names have one offset history."""
    if a is None or b is None or zone_of(a) is None or zone_of(b) is None:
        return False
    return all(np.array_equal(x, y) for x, y in zip(_history_of(a), _history_of(b)))


def instants(walls: np.ndarray, history: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first instant, last instant, skipped) of wall times in seconds: they differ for a time that occurs twice; a skipped one is read before the change."""
    at, offsets = history
    # a change ends the old offset's wall times at at + old offset, and begins the new one's at at + new offset
    until, since = at[1:] + offsets[:-1], at[1:] + offsets[1:]
    early = np.searchsorted(until, walls, "right")  # offsets whose wall times have ended
    late = np.searchsorted(since, walls, "right")  # offsets whose wall times have begun
    skipped = early > late
    first, last = np.minimum(early, late), np.maximum(early, late)
    last = np.where(skipped, first, last)
    return walls - offsets[first], walls - offsets[last], skipped


def normal_form(text: Column, order: Column, tz: Column) -> Column:
    """STRUCT<normal_form STRING, status STRING> of a written date."""

    @F.pandas_udf("normal_form string, status string")
    def parse(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, tuple] = {}
        for text, order, tz in texts:
            out = []
            for key in zip(text.tolist(), order.tolist(), tz.tolist()):
                if key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[key] = parse_date(*key)
                out.append(seen[key])
            yield pd.DataFrame(out, columns=["normal_form", "status"])

    return parse.asNondeterministic()(text, order, tz)  # else a filter on the result would have every string parsed twice


def normalise_dates(frame: DataFrame, text: str, order: str | Column, tz: str | Column, result: str = "normal_form", status: str = "date_status") -> DataFrame:
    """Append the normal form and the status of column ``text``; ``order`` and ``tz`` are column names or expressions."""
    order, tz = (F.col(x) if isinstance(x, str) else x for x in (order, tz))
    parsed = normal_form(F.col(text), order.cast("string"), tz.cast("string"))
    keep = [c for c in frame.columns if c not in (result, status)]
    return frame.select(*(F.col(f"`{c}`") for c in keep), parsed.alias("__date")).select(
        *(F.col(f"`{c}`") for c in keep), F.col("__date.normal_form").alias(result), F.col("__date.status").alias(status)
    )


def estimate_zones(frame: DataFrame, group: str, text: str, ingested: str, sequence: str | None = None, order: str | Column = "order", candidates: Sequence[str] | None = None) -> DataFrame:
    """(group, tz, n_violations, n_local, mean_lag_s): the zone whose offset history fits the group's local times best.

    ``ingested`` is when each row was stored, ``sequence`` an optional column in whose order the group's times never step back (a serial
    number, or an arrival time). ``candidates`` limits the zones; without it every offset history of the zone database is tried, and ``tz`` is the
    name that stands for it (``histories``). Groups without any local time give no row; null groups are one group; rows without ingestion time count for
    order and skipped times only.
    """
    order_col = F.col(order) if isinstance(order, str) else order
    zones = list(candidates) if candidates is not None else None

    @F.pandas_udf("bigint")
    def wall(text: pd.Series, order: pd.Series) -> pd.Series:
        found = [local_time(t, o) for t, o in zip(text, order)]
        return pd.Series([None if w is None else int(w.replace(tzinfo=timezone.utc).timestamp()) for w in found], dtype="Int64")

    rows = frame.select(
        F.col(group).alias("g"), wall.asNondeterministic()(F.col(text), order_col.cast("string")).alias("w"), F.col(ingested).cast("timestamp").cast("double").alias("at"),
        (F.col(sequence) if sequence else F.lit(None).cast("int")).alias("s"),
    ).where("w IS NOT NULL")
    kind = dict(frame.select(F.col(group).alias("g")).dtypes)["g"]
    if sequence:
        rows = rows.repartitionByRange(F.col("g"), F.col("s"), F.col("w")).sortWithinPartitions("g", "s", "w")

    def tried() -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return histories() if zones is None else {z: _history_of(z) for z in zones}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of a task by group and zone, and the first and last row of every group in it."""
        own, edges, part, names = {}, {}, None, []
        for batch in batches:
            if not len(batch):
                continue
            part, names = int(batch["part"].iloc[0]), names or list(tried())
            for g, rows_ in batch.groupby("g", sort=False, dropna=False):
                w, at = rows_["w"].to_numpy(np.int64), rows_["at"].to_numpy(float)
                key = None if pd.isna(g) else g
                total = own.setdefault(key, np.zeros((len(names), 4)))
                if sequence:
                    first, last = edges.get(key, (None, None))
                    w_all = w if last is None else np.concatenate([[last], w])
                    edges[key] = (w[0] if first is None else first, w[-1])
                for j, history in enumerate(tried().values()):
                    start, end, skipped = instants(w, history)
                    lag = at - start
                    fine = ~np.isnan(lag)
                    total[j] += (np.sum(lag[fine] < 0) + skipped.sum(), len(w), np.abs(lag[fine]).sum(), fine.sum())
                    if sequence and len(w_all) > 1:
                        first_, last_, _ = instants(w_all, history) if len(w_all) > len(w) else (start, end, None)
                        total[j, 0] += np.sum(last_[1:] < first_[:-1])
        for key, total in own.items():
            yield pd.DataFrame({"g": [key] * len(names), "k": range(len(names)), "z": names, "v": total[:, 0].astype(np.int64), "n": total[:, 1].astype(np.int64), "lag": total[:, 2], "m": total[:, 3].astype(np.int64), "part": -1, "first": 0, "last": 0})
        for key, (first, last) in edges.items():
            yield pd.DataFrame({"g": [key], "k": [0], "z": [None], "v": [0], "n": [0], "lag": [0.0], "m": [0], "part": [part], "first": [first], "last": [last]})

    counted = checkpointed(rows.select("g", "w", "at", F.spark_partition_id().alias("part")).mapInPandas(sums, f"g {kind}, k int, z string, v bigint, n bigint, lag double, m bigint, part int, first bigint, last bigint"))
    each = counted.where("part < 0").select("g", "k", "z", "v", "n", "lag", "m")
    if sequence:
        # the last row of a group in a task and the first one in the next: one row a task and group at most
        borders = counted.where("part >= 0").select("g", "last", F.lead("first").over(Window.partitionBy("g").orderBy("part")).alias("next")).where("next IS NOT NULL")

        def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k, (z, history) in enumerate(tried().items()):
                    back = instants(batch["next"].to_numpy(np.int64), history)[1] < instants(batch["last"].to_numpy(np.int64), history)[0]
                    yield pd.DataFrame({"g": batch["g"], "k": k, "z": z, "v": back.astype(np.int64), "n": 0, "lag": 0.0, "m": 0})

        each = each.unionByName(borders.mapInPandas(across, f"g {kind}, k int, z string, v bigint, n bigint, lag double, m bigint"))
    fits = each.groupBy("g", "k", "z").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), (F.sum("lag") / F.greatest(F.sum("m"), F.lit(1))).alias("lag"))
    best = fits.groupBy("g").agg(F.min_by(F.struct("z", "v", "n", "lag"), F.struct("v", "lag", "k")).alias("b"))
    return best.select(F.col("g").alias(group), F.col("b.z").alias("tz"), F.col("b.v").alias("n_violations"), F.col("b.n").alias("n_local"), F.col("b.lag").alias("mean_lag_s"))
