"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import oracle
import pytest

import __spark_entry__ as entry

Q, S = entry.queries(), entry.oracle_sql()
CORE = [n for n in S]


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, Q[name], S[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "doc_id", "score", "has_pii"]


@pytest.mark.parametrize("name", [n for n in Q if n not in S and not (n[0] == "p" and n[1].isdigit())])
def test_rows_only(spark, name):
    assert Q[name](spark, oracle.DATA).count() > 0
