import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import spans
from quirework.llm.spans import SharedSpans


def brute(texts, least):
    seen = {}
    for i, t in texts.items():
        for k in {t[j : j + least] for j in range(len(t) - least + 1)}:
            seen.setdefault(k, set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}


def covered(texts, least):
    out = {}
    for i, t in texts.items():
        others = {u[j : j + least] for k, u in texts.items() if k != i for j in range(len(u) - least + 1)}
        marks = [False] * len(t)
        for j in range(len(t) - least + 1):
            if t[j : j + least] in others:
                marks[j : j + least] = [True] * least
        out[i] = sum(marks)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc déя\n") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 260, 320, 700)]
    out = {i: word(rng.randint(0, 400)) + s + word(rng.randint(0, 400)) for i, s in enumerate(s for s in shared for _ in range(3))}
    out |= {100: out[0], 101: out[0], 102: "", 103: "x" * 500, 104: "x" * 700, 105: "short", 106: word(150) + "x" * 220, 107: shared[3] + word(50) + shared[4], 108: "😀" * 210, 109: "😀" * 210 + "z"}
    boiler = word(150)
    out |= {200 + i: boiler + word(300) for i in range(90)}  # a crowd that shares less than the least length
    return out


def test_hashes_do_not_depend_on_the_place():
    a, b = "x" * 7 + "abc" * 60 + "y", "abc" * 60
    assert (spans.window_hashes(a, 180)[7] == spans.window_hashes(b, 180)[0]) and len(spans.window_hashes("ab", 3)) == 0


def frame_of(spark, texts):
    rows = [(i, t, 1) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[0], (999, None, 1), (None, max(texts.values(), key=len), 1)], "id long, text string, c int").repartition(5)


def test_pairs_and_coverage_equal_brute_force(spark, texts):
    operator = SharedSpans(frame_of(spark, texts), "id", "text")
    assert sorted((r.id_a, r.id_b) for r in operator.pairs().collect()) == sorted(brute(texts, 200))
    got = {r.id: r.shared_chars for r in operator.coverage().collect()}
    expected = covered(texts, 200)
    assert got == {i: expected[i] for i in texts if len(texts[i]) >= 200}


def test_crowded_anchors_take_the_exact_way(spark, texts, monkeypatch):
    monkeypatch.setattr(spans, "CROWD", 1)
    operator = SharedSpans(frame_of(spark, texts), "id", "text")
    assert sorted((r.id_a, r.id_b) for r in operator.pairs().collect()) == sorted(brute(texts, 200))


@pytest.mark.parametrize("crowd", [1, 2, 3])
def test_coverage_with_crowded_anchors_equals_brute_force(spark, monkeypatch, crowd):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = word(900), word(250), word(400)
    texts = {1: a + word(80), 2: word(60) + a, 3: word(30) + a[:500] + word(90) + a[500:], 4: b + word(50) + a[300:], 5: word(40) + b + c, 6: c + b + c, 7: word(600), 8: a[100:350] + b[:199]}
    monkeypatch.setattr(spans, "CROWD", crowd)
    monkeypatch.setattr(spans, "BLOCK", 128)
    operator = SharedSpans(frame_of(spark, texts), "id", "text")
    assert {r.id: r.shared_chars for r in operator.coverage().collect()} == {i: n for i, n in covered(texts, 200).items() if len(texts[i]) >= 200}
    links = brute(texts, 200)
    assert {r.id: r.n_links for r in operator.coverage().collect()} == {i: sum(i in x for x in links) for i in texts if len(texts[i]) >= 200}


def test_hot_anchors_are_spread_without_a_change(spark, texts, monkeypatch):
    monkeypatch.setattr(spans, "SAMPLE", 1)
    monkeypatch.setattr(spans, "CROWD", 10)
    operator = SharedSpans(frame_of(spark, texts), "id", "text")
    assert operator._hot() and sorted((r.id_a, r.id_b) for r in operator.pairs().collect()) == sorted(brute(texts, 200))
    assert {r.id: r.shared_chars for r in operator.coverage().collect()} == {i: n for i, n in covered(texts, 200).items() if len(texts[i]) >= 200}


def test_common():
    assert spans.common("", "a") == 0 and spans.common("abc", "abd") == 2 and spans.common("abc", "abcd") == 3 and spans.common("xbc", "abc") == 0 and spans.common("ab", "ab") == 2


def test_empty(spark):
    frame = spark.createDataFrame([], "id long, text string")
    assert SharedSpans(frame, "id", "text").pairs().count() == 0
    with pytest.raises(ValueError):
        SharedSpans(frame, "id", "text", 50)
    assert F is not None
