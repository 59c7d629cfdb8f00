import glob
import os
import re

import pytest

import __spark_entry__ as entry
from quirework.plans import archive_queries, book_queries, data_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
OWN = {**book_queries.QUERIES, **archive_queries.QUERIES, **data_queries.QUERIES}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, duck, name):
    frame = OWN[name](spark, FOLDER)
    got = [tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()]
    sql = entry.oracle_sql().get(name)
    if not sql:
        assert frame.columns
        return
    result = duck.sql(sql)
    order = sorted(result.columns)
    assert order == sorted(frame.columns)
    expected = [tuple(row[result.columns.index(c)] for c in order) for row in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_styled_elements_reads_archives_twice(spark):
    """Once for nodes and once for rules, each pass behind one that writes them, and contents are gathered in one exchange."""
    frame = OWN["archive_styled_elements"](spark, FOLDER)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"MapIn(?:Arrow|Pandas) ", plan)) == 4
    assert plan.count("partial_collect_list(struct(spine_pos") == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
