"""Bound queries on tables whose days lie outside the usual ones: calendars come from the data."""

import os

import duckdb
import pytest
from oracle import TABLES, compare, duck

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = str(tmp_path_factory.mktemp("tables"))
    for name in TABLES:
        if name != "events":
            os.symlink(f"{SOURCE}/{name}.parquet", f"{made}/{name}.parquet")
    duckdb.execute(f"""COPY (
      SELECT * FROM '{SOURCE}/events.parquet' UNION ALL
      SELECT * REPLACE (event_id + 100000 AS event_id, ts + INTERVAL 60 DAY AS ts) FROM '{SOURCE}/events.parquet'
    ) TO '{made}/events.parquet' (FORMAT parquet)""")
    return made


@pytest.mark.parametrize("name", ["cutoff_align", "calendar_fill", "daily_filled", "weighted_mean"])
def test_late_events_stay(spark, folder, name):
    frame = entry.queries()[name](spark, folder)
    assert compare(frame, duck(folder), entry.oracle_sql()[name]) is None


def test_every_event_has_a_session(spark, folder):
    got = entry.queries()["cutoff_align"](spark, folder)
    assert got.count() == 2 * duckdb.sql(f"SELECT count(*) FROM '{SOURCE}/events.parquet'").fetchall()[0][0]
    assert got.filter("aligned_date > '2024-03-01'").count() > 0


def test_weekend_orders_count_on_monday(spark, folder):
    from tidepanel.bindings.base import Tables, prices

    got = prices(Tables(spark, folder))
    whole = duckdb.sql(f"SELECT sum(l_quantity) FROM '{SOURCE}/lineitem.parquet' JOIN '{SOURCE}/orders.parquet' ON l_orderkey = o_orderkey")
    assert got.agg({"stock_volume": "sum"}).first()[0] == whole.fetchall()[0][0]
    assert got.filter("weekday(date) > 4").count() == 0


def test_texts_without_an_event_stay(spark, folder):
    texts = duckdb.sql(f"SELECT (SELECT count(*) FROM '{SOURCE}/documents.parquet') + (SELECT count(*) FROM '{SOURCE}/conversations.parquet')")
    assert entry.queries()["post_union"](spark, folder).count() == texts.fetchall()[0][0]
