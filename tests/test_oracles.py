"""Each registered query of the library against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from gapwise.plans import queries as plans

ALL = plans.CATALOG | plans.TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame, columns):
    def plain(x):
        if x is None or isinstance(x, float) and x != x:
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(name for name, (_, sql) in ALL.items() if sql is not None))
def test_matches_sql(spark, duck, sf_dir, name):
    query, sql = ALL[name]
    ours, theirs = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
