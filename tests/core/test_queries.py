"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(entry.oracle_sql().keys() & entry.QUERIES.keys())


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, sf, sql, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    found = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_incremental_equals_full(spark, sf):
    """What the query builds from stale edges is what a scan of the remaining files gives."""
    got = {tuple(r)[1:] for r in entry.queries()["incremental_edges"](spark, sf).where("what = 'edge'").collect()}
    from arcspan.adapters import testdata as data

    gone = {r.id for r in data.modules(spark, sf).where("ord % 10 = 7").collect()}
    assert got == {(r.src, r.dst, r.specifier) for r in data.edges(spark, sf).collect() if not {r.src, r.dst} & gone}
