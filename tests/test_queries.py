"""Every array query against its SQL on the smallest tables."""

import duckdb
import pytest

from loomgrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equal_to_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(map(tuple, df.select(*names).collect())) == rows(want.fetchall())


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "matmul_gram" in entry.queries()
