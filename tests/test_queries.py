"""Every registered query runs on the smallest tables and agrees with its SQL."""

import os

import pytest

from tests.oracle import compare, connection
from weftline.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        compare(df, SQL[name], con)
    elif name == "louvain_modularity":
        n, communities, modularity = df.first()
        assert 1 < communities < n and 0.05 < modularity < 1
    else:
        assert name == "betweenness_sampled" and df.count() == con.sql(f"select count(*) from ({SQL['betweenness_karate']})").fetchall()[0][0]
        assert df.where("betweenness < 0").isEmpty() and not df.where("betweenness > 0").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
