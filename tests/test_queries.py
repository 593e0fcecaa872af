"""Every registered query against its SQL."""

import duckdb
import glob
import os

import pytest

import __spark_entry__ as entry
from check import _rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    found = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(found.columns, found.fetchall())


def test_every_query_of_the_planning_tables_has_sql():
    assert set(entry.REGISTRY) == set(entry.oracle_sql()) & set(entry.REGISTRY)


def test_version_feed_names_its_entries_in_the_order_of_the_sql(spark, tmp_path):
    """More changes at one time than the page holds: the ids decide which are listed, and in which order."""
    source = tmp_path / "events.parquet"
    connection = duckdb.connect()
    connection.sql(f"""copy (select i as event_id, i % 150 as user_id, case when i % 7 = 0 then 'error' else 'view' end as event_type,
        timestamp '2024-01-01 10:00:00.25' + to_days(cast(i // 150 as integer)) as ts, 1.5 as value from range(450) r(i)) to '{source}' (format parquet)""")
    connection.sql(f"create view events as select * from '{source}'")
    df = entry.queries()["audit_version_feed"](spark, str(tmp_path))
    found = connection.sql(entry.oracle_sql()["audit_version_feed"])
    assert df.columns == found.columns and "forecast_entry_id" in df.columns
    got = [tuple(r) for r in df.collect()]
    assert got == found.fetchall() and len({(r[0], r[1]) for r in got}) == len(got) == 200


def test_entry(spark):
    assert entry.entry(spark).count() == 144
