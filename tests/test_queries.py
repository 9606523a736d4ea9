"""Every query of the core against its SQL; those without SQL run. (Queries of subpackages are tested beside them.)"""

import pytest

from rangeloom.plans import codes, files, general, sequences, signals, trees

from .oracle import assert_same, views

MODULES = [general, signals, sequences, trees, codes, files]
QUERIES = {k: f for m in MODULES for k, f in m.queries().items()}
SQL = {k: q for m in MODULES for k, q in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def con(data):
    return views(data)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
