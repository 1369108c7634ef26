"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from stackmeter import queries as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(None if v != v else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    result = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in result.fetchall()]
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_without_oracle(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0
