"""Every registered graph query against its SQL on the smallest tables."""

import duckdb
import pytest

from lumengraph.plans import catalog, services  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def connection():
    own = duckdb.connect()
    for n in NAMES:
        own.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return own


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, connection, name):
    got = catalog.QUERIES[name](spark, SF)
    want = connection.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(names, want.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
