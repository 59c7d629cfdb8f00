import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import text_quality as q
from quirework.llm.boosting import BoostedTrees

COMMON = frozenset("the of and to in was that they it he she not have you with who there will had der die und nicht mit sie das ist les la le et une vous dans était der die das что не и он она мы все".split())


@pytest.fixture(scope="module")
def trees():
    texts = [t for _, t in q.HAND_CHECKED] * 4
    return q.train(texts, COMMON)


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] + (x[:, 1] > 0.5) * 2 > 0.5).astype(int) + 2 * (x[:, 2] > 1.5)
    y = np.minimum(y, 2)
    model = BoostedTrees(3).fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    p = model.probabilities(x[2500:])
    assert (p.argmax(1) == y[2500:]).mean() > 0.93 and np.allclose(p.sum(1), 1)
    assert model.probabilities(x[:0]).shape == (0, 3)


def test_hand_checked_kinds(trees):
    for kind, text in q.HAND_CHECKED:
        x = q.line_statistics(text.split("\n"), COMMON)
        votes = trees.probabilities(x).argmax(1)
        assert q.KINDS[np.bincount(votes, minlength=4).argmax()] == kind, text


def test_long_lines_are_read_to_their_end():
    start, junk = "the sea was not calm and they had to go with you ; " * 6, "xQzw ####### " * 200
    short, long, spaces = (q.line_statistics([t], COMMON)[0] for t in (start, start + junk, " " * 500 + "####"))
    odd, top = q.STATISTICS.index("odd_words"), q.STATISTICS.index("top_character")
    assert short[odd] < 0.05 and long[odd] > 0.7 and long[top] > 0.3 and 0 < spaces[top] < 0.1


def test_statistics_column(spark, trees):
    rows = [(1, "The sea was not calm.\nThey had to go."), (2, None), (3, ""), (4, " \n\t\n"), (5, "word " * 40_000), (1, "The sea was not calm.\nThey had to go.")]
    frame = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.s for r in frame.select("id", q.statistics(F.col("t"), trees, COMMON).alias("s")).collect()}
    assert got[1].n_lines == 2 and got[1].share_punctuated == 1.0 and got[1].share_common > 0.3 and abs(got[1].p_prose + got[1].p_list + got[1].p_table + got[1].p_junk - 1) < 1e-6
    assert got[2].n_lines == got[3].n_lines == got[4].n_lines == 0 and got[2].p_prose == 1.0 and got[5].n_lines == 1
    assert q.sample_texts(frame, "id", "t", 2) and q.sample_texts(frame.where("false"), "id", "t") == []
    words = {r.id: r.n for r in frame.select("id", q.count_words(F.col("t")).alias("n")).collect()}
    assert words[1] == 9 and words[3] == 0 and words[5] == 40_000
