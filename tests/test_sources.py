"""Readers and writers on temporary files, landing plans, audits."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidepanel import contract
from tidepanel.operators import audit
from tidepanel.sources import landed, landing, sinks

D = dt.date


def write(folder, name, text, mode="w"):
    path = folder / name
    path.write_bytes(text) if isinstance(text, bytes) else path.write_text(text, encoding="utf-8")
    return str(path)


def test_daily_csv(spark, tmp_path):
    write(tmp_path, "prices_aapl.csv", "Date,stock_price\n2024-01-05,1.5\nbad,2\n2024-01-06 10:00:00,x\n")
    write(tmp_path, "prices_tsla.csv", "Date,stock_price\n2024-01-05,7\n,8\n")
    frame = landed.read_daily_csv(spark, str(tmp_path), ["stock_price", "stock_volume"], r"_(\w+)\.csv$")
    got = sorted(tuple(r) for r in frame.select("ticker", "date", "stock_price", "stock_volume").collect())
    assert got == [
        ("AAPL", D(2024, 1, 5), 1.5, None), ("AAPL", D(2024, 1, 6), None, None), ("TSLA", D(2024, 1, 5), 7.0, None)
    ]
    with pytest.raises(KeyError):
        landed.read_daily_csv(spark, write(tmp_path, "none.csv", "day,x\n2024-01-01,1\n"))


def test_daily_csv_of_mixed_headers(spark, tmp_path):
    write(tmp_path, "p_aapl.csv", "Date,stock_price,stock_volume\n2024-01-05,1,2\n")
    write(tmp_path, "p_tsla.csv", "stock_volume,date,stock_price\n20,2024-01-05,10\n")
    write(tmp_path, "p_amd.csv", "date,note\n2024-01-06,x\n")
    write(tmp_path, "p_nil.csv", "")
    frame = landed.read_daily_csv(spark, str(tmp_path), ["stock_price", "stock_volume"], r"_(\w+)\.csv$")
    got = sorted(tuple(r) for r in frame.select("ticker", "date", "stock_price", "stock_volume").collect())
    assert got == [("AAPL", D(2024, 1, 5), 1.0, 2.0), ("AMD", D(2024, 1, 6), None, None), ("TSLA", D(2024, 1, 5), 10.0, 20.0)]


def test_numbers(spark):
    frame = spark.createDataFrame([(" 5 ",), ("1e3",), ("1d",), ("nan",), ("",), ("abc",), ("-2.5",)], "x string")
    assert [r.x for r in landed.coerce_numbers(frame, ["x"]).collect()] == [5.0, 1000.0, None, None, None, None, -2.5]


def test_ndjson(spark, tmp_path):
    lines = [
        b'{"id":"1","t":"ab\xffc"}', b"", b"{bad", b"[1,2]", b'[{"id":"9"}]', b'{"id":2,"t":{"a":1}}',
        b'"str"', b"5", b'  {"id":"3","t":null, "n": 12.0}  ', '{"id":"4","t":"é"}'.encode(), b'{"x":1}',
    ]
    path = write(tmp_path, "dump", b"\n".join(lines))
    got = [tuple(r) for r in landed.read_ndjson(spark, path, ["id", "t", "n"]).collect()]
    assert got == [
        ("1", "abc", None), ("2", '{"a":1}', None), ("3", None, "12.0"), ("4", "é", None), (None, None, None)
    ]


def test_metric_payloads(spark, tmp_path):
    folder = tmp_path / "good"
    folder.mkdir()
    write(folder, "a.csv", "sep=,\n﻿Date,Series,Value\n2024-01-01,\"Volume, all\",0.5\nbad,x,1\n2024-01-02,v,\n")
    write(folder, "b.csv", "﻿Value,Date\r\n3,2024-01-03\r\n")
    write(folder, "c.csv", "Date,Series\n2024-01-04,s\n")
    write(folder, "d.csv", "Date,Series,Value\n")
    got = sorted((r.date.day, r.v) for r in landed.read_metric_payloads(spark, str(folder), "v").collect())
    assert got == [(1, 0.5), (2, None), (3, 3.0), (4, None)]


def test_metric_payload_of_many_columns(spark, tmp_path):
    names = ",".join(f"c{i}" for i in range(12))
    path = write(tmp_path, "wide.csv", f'{names},Value,Date\n{"x," * 11}"a ""q"", b",7.5,2024-01-09\n')
    assert [tuple(r)[:2] for r in landed.read_metric_payloads(spark, path, "v").collect()] == [(D(2024, 1, 9), 7.5)]


@pytest.mark.parametrize("text", ["", "sep=,\n", "Day,Value\n2024-01-01,2\n"])
def test_bad_payload_fails(spark, tmp_path, text):
    path = write(tmp_path, "x.csv", text + "\n" if text else "\n")
    with pytest.raises(PySparkException):
        landed.read_metric_payloads(spark, path, "v").collect()


def test_window_files(spark, tmp_path):
    write(tmp_path, "Vol_2024-01-01_2024-01-02.csv", "Date,v\n2024-01-01,1\n2024-01-02,2\n")
    write(tmp_path, "Vol_2024-01-02_2024-01-03.csv", "Date,v\n2024-01-02,3\n2024-01-03,4\n")
    frame = landed.read_window_files(spark, str(tmp_path), ["v"], with_mode=True)
    assert frame.select("mode").distinct().collect()[0].mode == "Vol"
    rows = sorted((r.date.day, r.window_start.day, r.window_end.day, r.v) for r in frame.collect())
    assert rows == [(1, 1, 2, 1.0), (2, 1, 2, 2.0), (2, 2, 3, 3.0), (3, 2, 3, 4.0)]


def test_window_files_go_by_name(spark, tmp_path):
    write(tmp_path, "2024-01-01_2024-01-01.csv", "Date,a,b\n2024-01-01,1,2\n")
    write(tmp_path, "2024-01-02_2024-01-02.csv", "b,a,date\n2,1,2024-01-02\n")
    rows = landed.read_window_files(spark, str(tmp_path), ["a", "b"]).orderBy("date").collect()
    assert [(r.a, r.b, r.window_start) for r in rows] == [(1.0, 2.0, D(2024, 1, 1)), (1.0, 2.0, D(2024, 1, 2))]


def test_panel_goes_by_name(spark, tmp_path):
    write(tmp_path, "panel.csv", "stock_volume,date,ticker,stock_price,extra\n999,2024-01-05,A,10,x\n")
    row = landed.read_panel(spark, str(tmp_path / "panel.csv")).first()
    assert row.__fields__ == list(contract.PANEL_COLUMNS)
    assert (row.date, row.ticker, row.stock_price, row.stock_volume, row.company_name) == (D(2024, 1, 5), "A", 10.0, 999.0, None)


def test_present_files_keep_their_folder(spark, tmp_path):
    (tmp_path / "news").mkdir()
    (tmp_path / "forum").mkdir()
    write(tmp_path / "news", "A.csv", "date\n")
    present = landed.present_files(spark, str(tmp_path))
    assert [r.path for r in present.collect()] == ["news/A.csv"]
    manifest = spark.createDataFrame(
        [("T", "news", 0, "news/A.csv"), ("T", "forum", 0, "forum/A.csv")], "ticker string, source_name string, priority int, path string"
    )
    chosen = {r.source_name: r.selected_file for r in landed.choose_sources(manifest, present).collect()}
    assert chosen == {"news": "news/A.csv", "forum": None}


def test_prices(spark):
    raw = spark.createDataFrame(
        [(D(2024, 1, d), float(d), 9.0, 1.0) for d in (1, 2, 3)], "date date, Close double, Volume double, Open double"
    )
    got = landed.price_columns(raw, "2024-01-02", "2024-01-03")
    assert got.columns == ["date", "stock_price", "stock_volume"] and got.count() == 2
    with pytest.raises(RuntimeError):
        landed.price_columns(raw, "2025-01-02", "2025-01-03")
    with pytest.raises(RuntimeError):
        landed.price_columns(raw.drop("Close"), "2024-01-02", "2024-01-03")


def test_source_choice_and_audit(spark, tmp_path):
    write(tmp_path, "p_tsla.csv", "date\n")
    write(tmp_path, "p.csv", "date\n")
    write(tmp_path, "g_tsla.csv", "date\n")
    manifest = spark.createDataFrame(
        [("TSLA", "stock", 0, "p.csv"), ("TSLA", "stock", 1, "p_tsla.csv"), ("TSLA", "news", 0, "g.csv"),
         ("TSLA", "news", 1, "g_tsla.csv"), ("TSLA", "forum", 0, "f.csv")],
        "ticker string, source_name string, priority int, path string",
    )
    chosen = landed.choose_sources(manifest, landed.present_files(spark, str(tmp_path)))
    rows = spark.createDataFrame([("TSLA", "stock", D(2024, 1, 1)), ("TSLA", "stock", D(2024, 1, 3))], "ticker string, source_name string, date date")
    got = {r.source_name: (r.selected_file, r.used_fallback, r.rows, r.date_min, r.date_max) for r in audit.source_audit(chosen, rows).collect()}
    assert got == {
        "stock": ("p.csv", False, 2, "2024-01-01", "2024-01-03"), "news": ("g_tsla.csv", True, 0, None, None),
        "forum": (None, False, 0, None, None),
    }


def test_sinks_round_trip(spark, tmp_path):
    posts = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "ticker string, x int")
    sinks.write_posts(posts, str(tmp_path / "posts"))
    assert spark.read.parquet(str(tmp_path / "posts")).count() == 3
    assert {p.name for p in (tmp_path / "posts").iterdir() if p.is_dir()} == {"ticker=A", "ticker=B"}
    sinks.write_csv(posts, str(tmp_path / "csv"), ["x"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["ticker", "x"]
    sinks.write_json(posts.limit(1), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    todo = sinks.keys_to_build(
        spark.createDataFrame([("A",), ("C",)], "ticker string"), spark.read.parquet(str(tmp_path / "posts"))
    )
    assert [r.ticker for r in todo.collect()] == ["C"]


def test_panel_round_trip(spark, tmp_path):
    assert len(contract.PANEL_COLUMNS) == 39 and len(set(contract.PANEL_COLUMNS)) == 39
    row = [D(2024, 1, 1), "A", "a"] + [float(i) for i in range(36)]
    panel = spark.createDataFrame([row], landed.panel_schema())
    sinks.write_csv(panel, str(tmp_path / "panel"))
    assert tuple(landed.read_panel(spark, str(tmp_path / "panel")).first()) == tuple(row)
    sinks.write_panel(panel, str(tmp_path / "panel.parquet"))
    back = landed.read_panel(spark, str(tmp_path / "panel.parquet")).select(*contract.PANEL_COLUMNS)
    assert tuple(back.first()) == tuple(row)


def test_output_names(spark):
    frame = spark.createDataFrame(
        [("TSLA", "Tesla ", None), ("TSLA", "Tesla", "My Tag!"), ("AMD", "AMD", None), ("AMD", "AMD", "##"), ("X", "x", "-a_b-")],
        "t string, c string, g string",
    )
    got = [r[0] for r in frame.select(sinks.output_stem("prices", "base", F.col("t"), F.col("c"), F.col("g"))).collect()]
    assert got == ["base", "prices_my-tag", "prices_amd", "prices_amd", "prices_a_b"]


def test_window_plans(spark):
    spans = spark.createDataFrame([("A", D(2024, 1, 1), D(2024, 1, 10)), ("B", D(2024, 1, 2), D(2024, 1, 1))], "k string, start date, end date")
    plan = landing.plan_windows(spans, 3)
    got = sorted((r.window_start.day, r.window_end.day) for r in plan.collect())
    assert got == [(1, 4), (5, 8), (9, 10)]
    landed_windows = spark.createDataFrame([("A", D(2024, 1, 5))], "k string, window_start date")
    todo = landing.missing_windows(plan, landed_windows, ["k", "window_start"])
    assert sorted(r.window_start.day for r in todo.collect()) == [1, 9]
    days = landing.placeholder_days(todo.filter("window_start > '2024-01-05'"), "v").collect()
    assert sorted((r.date.day, r.v) for r in days) == [(9, None), (10, None)]


def test_key_lists(spark):
    lists = spark.createDataFrame([(0, "nvda, MSFT  aapl,"), (1, "msft,, tsla"), (2, " amd ")], "source int, text string")
    keys = landing.split_keys(lists, "text", "source")
    kept = landing.without_keys(keys, spark.createDataFrame([("AAPL",)], "ticker string"))
    got = [r.ticker for r in kept.orderBy("source", "position").collect()]
    assert got == ["NVDA", "MSFT", "TSLA", "AMD"]


def test_profiles(spark):
    profiles = spark.createDataFrame(contract.TICKER_PROFILES, "ticker string, company_name string, trends_query string, gdelt_query string")
    asked = spark.createDataFrame(
        [(" amd", None, None, None), ("zzz", None, None, None), ("tsla", " Tesla Inc ", "", None), ("qq", "Quux", None, " ")],
        "ticker string, company_name string, trends_query string, gdelt_query string",
    )
    got = {r.ticker: tuple(r)[1:] for r in landing.resolve_profiles(asked, profiles).collect()}
    assert got == {
        "AMD": ("AMD", "AMD stock", '"Advanced Micro Devices"'), "ZZZ": ("ZZZ", "ZZZ", "(ZZZ)"),
        "TSLA": ("Tesla Inc", "Tesla Inc", '("Tesla" OR TSLA)'), "QQ": ("Quux", "Quux", "(Quux OR QQ)"),
    }


def test_coverage_summary_and_document(spark):
    daily = spark.createDataFrame(
        [("A", "subm", D(2024, 1, 1), 3, 0.0), ("A", "subm", D(2024, 1, 2), None, None), ("A", "comm", D(2024, 1, 1), 0, 0.5)],
        "ticker string, kind string, date date, reddit_posts bigint, reddit_finbert_mean double",
    )
    coverage = audit.coverage_audit(daily, ["subm", "comm"])
    r = coverage.first()
    assert (r.subm_days, r.subm_days_with_posts, r.subm_post_coverage, r.subm_finbert_null_days, r.subm_finbert_zero_days) == (2, 1, 0.5, 1, 1)
    assert (r.comm_days, r.comm_days_with_posts, r.comm_post_coverage) == (1, 0, 0.0)
    summary = audit.panel_summary(daily, {"null_rate": "reddit_finbert_mean"})
    assert {x.metric: x.value for x in summary.collect()} == {
        "rows": "3", "tickers": "1", "date_min": "2024-01-01", "date_max": "2024-01-02", "null_rate": "0.333333"
    }
    sources = spark.createDataFrame([("A", "stock", "p.csv")], "ticker string, source_name string, selected_file string")
    document = audit.metadata_document(daily, sources, coverage, {"output_path": "o"}, ["n1"])
    made = json.loads(document.toJSON().first())
    assert made["tickers_included"] == ["A"] and made["rows"] == 3 and made["notes"] == ["n1"] and made["output_path"] == "o"
    assert made["raw_source_rows"][0]["selected_file"] == "p.csv" and made["coverage_rows"][0]["subm_days"] == 2
    assert audit.metadata_records(sources, coverage).count() == 2


def test_an_ordered_table_reads_back_in_order(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("_note")).repartition(7)
    path = str(tmp_path / "ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_ordered(rows, path, ["x"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = sinks.read_ordered(spark, path)
    assert found.columns == ["x", "_note", "position"]
    assert all(r.position == r.x + 1 for r in found.collect()) and found.count() == 1000
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) > 1
    sinks.write_ordered(rows.filter("x < 0"), path, ["x"])
    assert sinks.read_ordered(spark, path).count() == 0
