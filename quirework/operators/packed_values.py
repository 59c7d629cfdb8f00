"""Several values packed in one field: one row per value, with its position kept.

``split_packed`` explodes the array elements and parses each distinct string once per Arrow batch with the grammar of
``functions/packed.py``. The known single values (a controlled vocabulary) travel with the function; their number is
checked against ``MAX_TERMS`` first, and a larger vocabulary is left out with an error rather than shipped silently.

Defined results: null arrays, null, blank and separator-only elements give no row; a single value gives one row with
``n_parts`` 1; repeated rows are kept (deduplicate before or after); clashing column names of the input are
impossible because only the key columns and the fixed result columns are returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions.packed import Grammar

MAX_TERMS = 100_000
_PARTS = "array<struct<part_pos int, part_text string, n_parts int, flag string>>"


def vocabulary(frame: DataFrame, column: str) -> list[str]:
    """The distinct terms of a controlled vocabulary on the driver, refused above ``MAX_TERMS``."""
    rows = frame.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary of more than {MAX_TERMS} terms can't be shipped with the grammar")
    return sorted(r[0] for r in rows)


def split_packed(frame: DataFrame, key: str, field: str, terms: Sequence[str] = (), people: bool = False) -> DataFrame:
    """(key, field, elem_pos, part_pos, part_text, n_parts, flag) of an ARRAY<STRING> column (or a STRING column)."""
    terms = list(terms)

    @F.pandas_udf(_PARTS)
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(terms, people)
        seen: dict[str, list] = {}
        for batch in batches:
            out = []
            for text in batch:
                if text not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    values, flag = grammar.parse(text)
                    seen[text] = [{"part_pos": i, "part_text": v, "n_parts": len(values), "flag": flag} for i, v in enumerate(values)]
                out.append(seen[text])
            yield pd.Series(out)

    column = F.col(f"`{field}`")
    if not dict(frame.dtypes)[field].startswith("array"):
        column = F.array(column)
    elements = frame.select(F.col(f"`{key}`").alias("__key"), F.posexplode(column).alias("elem_pos", "__element"))
    return (
        elements.where(F.trim("__element") != "")
        .select("__key", "elem_pos", F.explode(parts("__element")).alias("p"))
        .select(F.col("__key").alias(key), F.lit(field).alias("field"), "elem_pos", "p.part_pos", "p.part_text", "p.n_parts", "p.flag")
    )
