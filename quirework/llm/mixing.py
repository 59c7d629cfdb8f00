"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every record gets an exponential key, -ln(u) / weight, from a hash of its id and the seed; a source's records in order of their keys are
a weighted sample without replacement, and its prefix up to a token budget is the selection. A source that must give more than
it has gives whole epochs first and the selection from one more. The total is the largest that every source can reach within its
cap of repeats, unless one is given.

A source can hold most of the rows, so it is never sorted as a whole: the logarithms of keys are mapped to ``BINS`` intervals, token sums of the
intervals (at most sources x BINS rows) tell in which one a budget ends, and this one is divided again until it holds at most ``SORT_ROWS``
records; only these are sorted.

Defined results: null or non-positive sizes count as 0 tokens and are never selected by a fraction; null sources and sources without a target are left
out; null weights are 1; ties of keys are told apart by id; repeated ids are one record; a target source without records is reported with 0 tokens and doesn't limit the
total; empty tables give an empty mix; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096
SORT_ROWS = 50_000
LOW, HIGH = -700.0, 60.0  # of the logarithm of any key
MOST_SOURCES = 10_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of a key."""
    return (F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def totals(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens): what every target source has; one row per source of ``targets``."""
    have = records.groupBy("source").agg(F.sum("n").alias("tokens"))
    return targets.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


def budget_ends(keyed: DataFrame) -> dict[str, tuple[float, float, int]]:
    """Source -> (low, high, tokens before) of the interval of ``t`` in which its ``part`` of tokens ends; sources whose part takes all or nothing have none.

    Each round divides the open intervals into ``BINS``; at most one row a source reaches the driver.
    """
    spark = keyed.sparkSession
    done: dict[str, tuple[float, float, int]] = {}
    open_ = {r.source: (LOW, HIGH, 0) for r in keyed.where("part > 0").select("source").distinct().limit(MOST_SOURCES + 1).collect()}
    while open_:
        bounds = spark.createDataFrame([(s, *e) for s, e in open_.items()], "source string, low double, high double, before long")
        bin_ = F.floor((F.col("t") - F.col("low")) / (F.col("high") - F.col("low")) * BINS).cast("int")
        sums = keyed.join(F.broadcast(bounds), "source").where("t >= low AND t < high").groupBy("source", F.least(F.lit(BINS - 1), bin_).alias("bin")).agg(
            F.sum("n").alias("b"), F.count("*").alias("k"), F.first("part").alias("part"), F.first("before").alias("start"), F.min("t").alias("least"), F.max("t").alias("most")
        )
        earlier = F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = sums.withColumn("before", F.col("start") + earlier).where("before <= part AND before + b > part")
        rows = found.groupBy("source").agg(F.min(F.struct("bin", "before", "k", "least", "most")).alias("x")).select("source", "x.*").collect()
        open_ = {}
        for r in rows:  # the interval of the keys that lie in it
            interval = (r.least, math.nextafter(r.most, math.inf), r.before)
            (done if r.k <= SORT_ROWS or r.least == r.most else open_)[r.source] = interval
    return done


def mix(records: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selected, report): ``records`` has id, source, n (tokens) and weight; ``targets`` source, target_share and max_repeats.

    selected: (id, source, n, repeats) of every record that is used at least once. report: (source, target_share, tokens, budget,
    mixed_tokens, actual_share, epochs, max_repeats). ``records`` is read several times: give a table or a checkpoint.
    """
    records = records.select("id", "source", F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"), F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(1e-6)).alias("weight")).dropDuplicates(["id"])
    targets = targets.where("source IS NOT NULL AND target_share > 0").select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    if targets.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:  # the plan of the sources is broadcast
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    have = totals(records, targets)
    reach = have.where("tokens > 0").agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    most = F.lit(float(reach if total is None else min(reach, total)))
    plan = have.withColumn("budget", F.when(F.col("tokens") > 0, F.floor(most * F.col("target_share"))).otherwise(0).cast("bigint"))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("part", F.col("budget") - F.col("epochs") * F.col("tokens"))
    u = uniform(F.col("id"), seed)
    keyed = records.join(F.broadcast(plan.select("source", "epochs", "part")), "source").withColumn("key", -F.log(u) / F.col("weight")).withColumn("t", F.log(F.greatest("key", F.lit(1e-300))))
    ends = budget_ends(keyed)
    spark = records.sparkSession
    bounds = spark.createDataFrame([(s, *e) for s, e in ends.items()], "source string, low double, high double, before long")
    keyed = keyed.join(F.broadcast(bounds), "source", "left")  # one row a source at most
    inside = keyed.where("t >= low AND t < high").withColumn("sum", F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)))
    chosen = inside.select("id", "source", "n", "epochs", (F.col("sum") <= F.col("part")).alias("more")).unionByName(
        keyed.where("low IS NULL OR t < low OR t >= high").select("id", "source", "n", "epochs", F.when(F.col("low").isNull(), F.col("part") > 0).otherwise(F.col("t") < F.col("low")).alias("more"))
    )
    selected = chosen.select("id", "source", "n", (F.col("epochs") + F.coalesce(F.col("more").cast("int"), F.lit(0))).alias("repeats")).where("repeats > 0")
    used = selected.groupBy("source").agg(F.sum(F.col("n") * F.col("repeats")).alias("mixed_tokens"))
    each = plan.join(F.broadcast(used), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("bigint"))
    each = each.withColumn("all_tokens", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))  # at most MOST_SOURCES rows
    report = each.select(
        "source", "target_share", "tokens", "budget", "mixed_tokens", (F.col("mixed_tokens") / F.greatest("all_tokens", F.lit(1))).alias("actual_share"), "epochs", "max_repeats"
    )
    return selected, report
