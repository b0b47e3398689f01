"""Every catalogue query with SQL against DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from swathly.plans import catalog
from swathly.session import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_exact_time_with_equal_and_missing_times(spark, tmp_path):
    con = duckdb.connect(config={"threads": 1})  # so that arg_min takes equal times in the table's order
    con.execute(f"COPY (SELECT CASE WHEN e.event_id % 5 <> i THEN e.event_id + 1000 * i END AS event_id, CASE WHEN e.event_id % 7 <> i THEN ts END AS ts FROM range(9) g(i), '{SF}/events.parquet' e ORDER BY i, e.event_id) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = con.execute(catalog.ORACLE["q_exact_time"])
    columns = [d[0] for d in got.description]
    df = catalog.QUERIES["q_exact_time"](spark, str(tmp_path))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, got.fetchall())
