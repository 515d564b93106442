"""Every query of the reference's operators beside its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from snapweave.plans import folders, history, listing, reports

DATA = "/root/testdata/sf0.001"
CASES = [(name, fn, sql) for plan in (history, folders, reports, listing) for name, (fn, sql) in plan.QUERIES.items()]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "__float__"):
        return f"{float(value):.6g}"
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize(("name", "fn", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, db, name, fn, sql):
    got = fn(spark, DATA)
    values = got.collect()
    if sql is None:
        assert values
        return
    wanted = db.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, values) == rows(names, wanted.fetchall())


#: What deals with times: the answer may not hang on the session's zone.
TIMED = ("transfer_rates", "stream_transfer_rates", "daily_saves", "long_report", "stream_daily_counts", "stream_fresh_events", "price_as_of", "version_delta")


@pytest.mark.parametrize("name", TIMED)
@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu"])
def test_other_zones_and_more_rows(spark, name, zone):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem", "documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    fn, sql = next((fn, sql) for n, fn, sql in CASES if n == name)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = fn(spark, data)
        values = got.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    wanted = con.execute(sql)
    assert rows(got.columns, values) == rows([c[0] for c in wanted.description], wanted.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
