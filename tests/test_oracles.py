"""Every registered query with a DuckDB twin gives the same rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from docquarry.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LISTED = sorted(catalog.oracle_sql())


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", LISTED)
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert ours


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(LISTED)))
def test_runs_without_a_twin(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0
