import os

import pytest

from netloom.plans import oracle
from netloom.plans import queries as registered

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
TABLES = ("customer", "events", "lineitem", "nation", "orders", "pages", "supplier")


def plain(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registered.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.execute(oracle.oracle_sql()[name]).to_arrow_table()
    assert sorted(rel.column_names) == cols
    got, want = plain(map(tuple, df.select(*cols).collect())), plain(zip(*(rel.column(c).to_pylist() for c in cols), strict=True))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, int | float) for x in a) else a == b


def test_every_query_has_its_name_and_rest_runs(spark):
    found = registered.queries()
    assert set(oracle.oracle_sql()) <= set(found)
    for name in sorted(set(found) - set(oracle.oracle_sql())):
        assert found[name](spark, SMALL).columns, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
