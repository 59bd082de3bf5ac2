"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

from corpuswright.queries import REGISTRY
from tools.check import compare, duck

TWINS = [n for n, q in REGISTRY.items() if q.sql is not None]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, sf, con, name):
    q = REGISTRY[name]
    df = q.run(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    assert compare(rows, df.columns, cur.fetchall(), cols) is None


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert REGISTRY.keys() <= entry.queries().keys()
    # what else there is are the queries of training data, if that subpackage is there
    more = entry.queries().keys() - REGISTRY.keys()
    assert all(name == "pipeline" or name.startswith("op") for name in more)
