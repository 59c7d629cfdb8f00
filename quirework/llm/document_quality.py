"""Quality weights of documents: boosted trees on statistics of whole documents.

The statistics are JVM expressions over whole texts, so that only a few numbers a document reach Python. The trees are trained on a bounded
sample of at most ``SAMPLE_DOCUMENTS`` documents, chosen by the hash of their key, which the trees of ``text_quality`` label by their lines: a document is
prose if more than half of its lines are. A quarter of the sample is held out and calibrates the probabilities.

Defined results: null, empty and blank texts have the least weight; extra columns are ignored; where the sample has documents of one kind only, or none, the weight is 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm import mojibake
from quirework.llm import text_quality as quality
from quirework.llm.boosting import BoostedTrees

SAMPLE_DOCUMENTS = 1_000
LEAST = 0.05  # of any weight, so that every document can be chosen


def document_statistics(text: Column) -> list[Column]:
    """Numbers that describe a whole text; each is null-safe."""
    own = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(own), F.lit(1)).cast("double")
    lines = F.size(F.split(own, "\n")).cast("double")
    letters = F.char_length(F.regexp_replace(own, r"\P{L}+", "")).cast("double")
    words = F.regexp_count(own, F.lit(r"\p{L}+")).cast("double")
    return [
        F.log1p(size), letters / size, F.char_length(F.regexp_replace(own, r"\D+", "")) / size, F.char_length(F.regexp_replace(own, r"[^{}\[\]|<>=#*_~^\\/&]+", "")) / size, letters / F.greatest(words, F.lit(1.0)),
        words / lines, F.regexp_count(own, F.lit(r"""(?m)[.!?…][”"»’')\]]*$""")) / lines, F.regexp_count(own, F.lit(r"(?m)^\s*[*#|•!{–-]")) / lines,
    ]


def train(frame: DataFrame, key: str, text: str, common: frozenset[str], size: int = SAMPLE_DOCUMENTS) -> BoostedTrees | None:
    """Trees that tell prose (class 1) from other documents; None if the sample doesn't have both."""
    hashed = frame.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string")).alias("h"))
    last = hashed.distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if last is None:
        return None
    some = frame.where(F.col(text).isNotNull() & (F.xxhash64(F.col(key).cast("string")) <= last)).select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(text).alias("t"), F.array(*document_statistics(F.col(text))).alias("x")).dropDuplicates(["h"])
    rows = sorted(some.collect(), key=lambda r: (r.h, r.t))  # at most ``size``
    by_line = quality.train([r.t for r in rows], common)
    x, y = [], []
    for r in rows:
        lines = [s for s in mojibake.plain(r.t).split("\n") if s and not s.isspace()]
        prose = by_line.probabilities(quality.line_statistics(lines, common)).argmax(1) == 0
        x.append(r.x)
        y.append(int(len(lines) > 0 and prose.mean() > 0.5))
    if len(set(y)) < 2:
        return None
    x_, y_ = np.array(x), np.array(y)
    held = np.arange(len(y_)) % 4 == 0
    return BoostedTrees(2).fit(x_[~held], y_[~held]).calibrate(x_[held], y_[held])


def quality_weight(text: Column, trees: BoostedTrees | None) -> Column:
    """Weight of a document between ``LEAST`` and 1: the probability that it is prose."""
    if trees is None:
        return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(LEAST)).otherwise(F.lit(1.0))

    @F.pandas_udf("double")
    def prose(x: pd.Series) -> pd.Series:
        return pd.Series(trees.probabilities(np.stack(x.to_numpy()))[:, 1] if len(x) else [], dtype="float64")

    found = prose.asNondeterministic()(F.array(*document_statistics(text)))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(LEAST)).otherwise(F.greatest(F.lit(LEAST), found))
