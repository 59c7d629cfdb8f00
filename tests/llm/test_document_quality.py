import random

from pyspark.sql import functions as F

from quirework.llm import document_quality as d

COMMON = frozenset("the of and to in was that they it he she not have you with who there will had".split())


def test_weights_tell_prose_from_other_documents(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "sea", "was", "calm", "they", "walked", "and", "river", "not", "had", "house", "light"])
    prose = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(8, 30))).capitalize() + "." for _ in range(rng.randint(2, 6)))
    table = lambda: "{| class=wiki\n" + "\n".join(f"| {word()} | {rng.randint(1, 999)} | {rng.randint(1, 999)}% |" for _ in range(rng.randint(4, 12))) + "\n|}"
    rows = [(i, prose() if i % 2 else table(), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "The sea was calm. " * 5000, "x"), (1, prose(), "x")]
    frame = spark.createDataFrame(rows, "id long, text string, weight string")
    trees = d.train(frame, "id", "text", COMMON, size=300)
    got = [(r.id, r.w) for r in frame.select("id", d.quality_weight(F.col("text"), trees).alias("w")).collect()]
    assert all(d.LEAST <= w <= 1 for _, w in got) and {w for i, w in got if i in (900, 901, 902)} == {d.LEAST}
    right = [(w > 0.5) == (i % 2 == 1) for i, w in got if i < 400]
    assert sum(right) / len(right) > 0.97


def test_without_both_kinds_all_weigh_the_same(spark):
    frame = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    assert d.train(frame.where("false"), "id", "text", COMMON) is None
    assert {r.id: r.w for r in frame.select("id", d.quality_weight(F.col("text"), None).alias("w")).collect()} == {1: 1.0, 2: d.LEAST}
