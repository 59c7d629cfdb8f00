import os

import pytest

from quirework.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    frame, result = queries.QUERIES[name](spark, FOLDER), connection.sql(queries.SQL[name])
    order = sorted(frame.columns)
    assert order == sorted(result.columns)
    expected = [tuple(row[result.columns.index(c)] for c in order) for row in result.fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in frame.collect()))) == sorted(map(repr, expected))
