import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import packing, tokens
from quirework.llm.mixing import mix
from quirework.llm.packing import nnls, pack, plan


def test_nnls_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12)
    x = nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and w.max() < 1e-6 and abs(w[x > 1e-9]).max() < 1e-6


@pytest.mark.parametrize("histogram", [{}, {64: 3}, {1: 1}, {40: 7, 24: 7}, {k: (k * 37) % 50 for k in range(1, 65)}])
def test_plan_uses_every_item_once(histogram):
    used = Counter()
    for pattern, times in plan(histogram):
        assert sum(pattern) <= packing.BINS and times > 0
        for k in pattern:
            used[k] += times
    assert used == Counter({k: v for k, v in histogram.items() if v})


def check(rows, sizes, capacity):
    parts, room = defaultdict(list), Counter()
    for r in rows:
        parts[r.doc].append((r.piece, r.n))
        room[r.container] += r.n
    assert max(room.values(), default=0) <= capacity
    for doc, n in sizes.items():
        own = sorted(parts.pop(doc, []))
        assert sum(p for _, p in own) == max(0, n or 0) and [i for i, _ in own] == list(range(len(own)))
        assert len(own) == (0 if not n or n < 1 else -(-n // capacity))
    assert not parts
    return sum(room.values()) / (len(room) * capacity) if room else 1.0


@pytest.mark.parametrize("capacity", [1, 7, 512, 2048])
def test_pack(spark, capacity):
    rng = random.Random(capacity)
    sizes = {i: int(rng.lognormvariate(5.5, 1)) if capacity > 10 else rng.randint(0, 20) for i in range(3000)} | {5000: None, 5001: 0, 5002: -3, 5003: capacity, 5004: 3 * capacity, 5005: 3 * capacity + 1}
    frame = spark.createDataFrame([(i, n, 0, 0) for i, n in sizes.items()] + [(5003, capacity, 0, 0)], "doc long, tokens int, unit int, bin int")
    filled = check(pack(frame, "doc", "tokens", capacity).collect(), sizes, capacity)
    assert filled > 0.9


def test_pack_edges(spark):
    frame = spark.createDataFrame([], "doc long, tokens int")
    assert pack(frame, "doc", "tokens", 10).count() == 0
    with pytest.raises(ValueError):
        pack(frame, "doc", "tokens", 0)


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, n int, weight double, bin int")


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 10 else "small", rng.randint(1, 500), rng.random(), 1) for i in range(5000)] + [(9000, None, 5, 1.0, 1), (9001, "other", 5, 1.0, 1), (9002, "big", None, None, 1), (1, "big", 99, 0.5, 1)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    selected, report = mix(records(spark, rows), targets)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"big", "small"} and abs(got["big"].actual_share - 0.6) < 0.01 and abs(got["small"].actual_share - 0.4) < 0.01
    repeats = Counter()
    for r in selected.collect():
        assert 1 <= r.repeats <= {"big": 1, "small": 3}[r.source]
        repeats[r.source, r.repeats] += 1
    assert got["small"].epochs >= 1 and all(k >= got["small"].epochs for s, k in repeats if s == "small")
    assert sum(got[s].budget - got[s].mixed_tokens < 1000 for s in got) == 2


def test_heavier_records_are_chosen_more_often(spark):
    rows = [(i, "a", 1, 1.0 if i % 2 else 0.1, 1) for i in range(4000)]
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selected, report = mix(records(spark, rows), targets, total=1000)
    heavy = sum(r.id % 2 for r in selected.collect())
    assert selected.count() == 1000 and heavy > 800 and report.first().mixed_tokens == 1000
    again = {r.id for r in mix(records(spark, rows), targets, total=1000)[0].collect()}
    assert again == {r.id for r in selected.collect()} != {r.id for r in mix(records(spark, rows), targets, seed=5, total=1000)[0].collect()}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selected, report = mix(records(spark, []), targets)
    assert selected.count() == 0 and report.first().mixed_tokens == 0
    assert mix(records(spark, [(1, "a", 1, 1.0, 1)]), targets.where("false"))[0].count() == 0


def test_tokens(spark):
    frame = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",), ("x" * 50_000,)], "t string")
    from pyspark.sql import functions as F

    got = [r[0] for r in frame.select(tokens.count_tokens(F.col("t"))).collect()]
    assert got[:3] == [2, None, 0] and got[3] > 1 and got[4] > 100


@pytest.mark.parametrize("histogram", [{k: 1000 + k * 37 % 50 for k in range(1, 65)}, {k: 100_000 // k for k in range(1, 17)}, {k: 500 for k in range(1, 35)}])
def test_plan_fills_with_many_classes(histogram):
    used = plan(histogram)
    assert sum(k * n for k, n in histogram.items()) / (packing.BINS * sum(n for _, n in used)) > 0.995


def test_priced_equals_brute_force():
    rng = np.random.default_rng(1)
    for least in (packing.BINS, packing.BINS - 1, 50):
        bins, values = [31, 20, 17, 13], rng.normal(size=packing.BINS + 1)
        every = packing.few_patterns(bins, least, 64)
        assert len(set(every)) == len(every) and all(least <= sum(p) <= packing.BINS for p in every)
        worth, pattern = packing.priced(values, bins, least)
        if every:
            assert pattern in every and abs(worth - max(sum(values[k] for k in p) for p in every)) < 1e-9
        else:
            assert worth == -np.inf and pattern == ()


def test_pack_all_equals_single_packs(spark):
    frame = spark.createDataFrame([(f"d{i}", (i * 7919) % 900) for i in range(1500)] + [(None, 5)], "doc string, tokens int")
    rows = packing.pack_all(frame, "doc", "tokens", [("a", 256), ("b", 1000)]).collect()
    for name, capacity in (("a", 256), ("b", 1000)):
        alone = packing.pack(frame, "doc", "tokens", capacity).collect()
        assert sorted((r.container, r.doc or "", r.piece, r.n) for r in rows if r.pack_name == name) == sorted((r.container, r.doc or "", r.piece, r.n) for r in alone)
    assert packing.pack_all(frame, "doc", "tokens", []).count() == 0
    with pytest.raises(ValueError):
        packing.pack_all(frame, "doc", "tokens", [("a", 1), ("a", 2)])


def test_intervals_are_divided_until_they_are_small(spark, monkeypatch):
    """The same selection as by sorting whole sources, also where nearly all keys lie close together."""
    import math

    from quirework.llm import mixing

    rng = random.Random(4)
    rows = [(i, "a", rng.randint(1, 40), 0.05) for i in range(3000)] + [(i, "b", 7, 1e12) for i in range(3000, 3500)] + [(i, "c", rng.randint(1, 9), float("inf")) for i in range(4000, 4100)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.03, 1), ("c", 0.47, 5)], "source string, target_share double, max_repeats int")
    frame = spark.createDataFrame(rows, "id long, source string, n long, weight double").repartition(5)
    whole = {(r.id, r.repeats) for r in mix(frame, targets, seed=3)[0].collect()}
    monkeypatch.setattr(mixing, "SORT_ROWS", 5)
    monkeypatch.setattr(mixing, "BINS", 8)
    selected, report = mix(frame, targets, seed=3)
    assert {(r.id, r.repeats) for r in selected.collect()} == whole
    budgets = {r.source: (r.budget, r.tokens) for r in report.collect()}
    keys = {r.id: -math.log(r.u) for r in frame.select("id", mixing.uniform(F.col("id"), 3).alias("u")).collect()}
    for source in "ab":
        budget, tokens = budgets[source]
        own, total, expected = sorted((keys[i] / w, i, n) for i, s, n, w in rows if s == source), 0, set()
        for _, i, n in own:
            total += n
            if total > budget % tokens:
                break
            expected.add(i)
        assert {i for i, k in whole if any(r[0] == i and r[1] == source for r in rows)} == expected
