"""Hand-computed session mapping."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.operators.calendar import align_posts, day_grid, fill_calendar, map_to_next_session
from tidepanel.operators.panel import (
    dedupe_dates,
    join_volume_tone,
    mean_duplicates,
    require_unique,
    session_rollup,
)

D = dt.date
SESSIONS = [("A", D(2024, 1, 5)), ("A", D(2024, 1, 8))]


def sessions(spark, rows=SESSIONS):
    return spark.createDataFrame(rows, "ticker string, session_date date")


def test_forward_lookup(spark):
    days = [("A", D(2024, 1, d)) for d in (1, 5, 6, 8, 9)] + [("B", D(2024, 1, 5))]
    frame = spark.createDataFrame(days, "ticker string, date date")
    found = {r.date.day: r.session_date.day for r in map_to_next_session(frame, sessions(spark)).collect()}
    assert found == {1: 5, 5: 5, 6: 8, 8: 8}


def test_tolerance_and_unmatched(spark):
    frame = spark.createDataFrame([("A", D(2024, 1, d)) for d in (1, 4, 9)], "ticker string, date date")
    mapped = map_to_next_session(
        frame, sessions(spark), tolerance_days=2, keep_unmatched=True, row_level=True
    ).collect()
    assert {r.date.day: r.session_date and r.session_date.day for r in mapped} == {1: None, 4: 5, 9: None}


def test_shared_calendar_needs_no_join(spark):
    frame = spark.createDataFrame([("A", D(2024, 1, 6))], "ticker string, date date")
    mapped = map_to_next_session(frame, sessions(spark).drop("ticker"), key=None)
    assert mapped.first().session_date == D(2024, 1, 8)
    plan = mapped._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.integers(0, 60), min_size=1, max_size=12, unique=True),
    st.lists(st.integers(0, 70), min_size=1, max_size=30),
)
def test_forward_lookup_matches_merge_asof(spark, session_days, days):
    base = D(2024, 1, 1)
    right = pd.DataFrame({"session_date": pd.to_datetime([base + dt.timedelta(d) for d in sorted(session_days)])})
    left = pd.DataFrame({"date": pd.to_datetime([base + dt.timedelta(d) for d in sorted(days)])})
    wanted = pd.merge_asof(left, right, left_on="date", right_on="session_date", direction="forward").dropna()
    mapped = map_to_next_session(
        spark.createDataFrame([("A", base + dt.timedelta(d)) for d in days], "ticker string, date date"),
        sessions(spark, [("A", base + dt.timedelta(d)) for d in session_days]),
    ).collect()
    got = sorted((r.date, r.session_date) for r in mapped)
    assert got == sorted((a.date(), b.date()) for a, b in wanted.itertuples(index=False))


def epoch(text: str) -> int:
    return int(pd.Timestamp(text, tz="America/New_York").timestamp())


@pytest.mark.parametrize(
    "local, wanted",
    [
        ("2024-01-05 09:29:59", D(2024, 1, 5)),
        ("2024-01-05 09:30:00", D(2024, 1, 8)),
        ("2024-01-05 16:30:00", D(2024, 1, 8)),
        ("2024-01-06 08:00:00", D(2024, 1, 8)),
        ("2024-01-08 09:30:00", None),
        ("2023-12-31 23:59:00", D(2024, 1, 5)),
    ],
)
def test_cutoff(spark, local, wanted):
    posts = spark.createDataFrame([("A", epoch(local))], "ticker string, created_utc bigint")
    row = align_posts(posts, sessions(spark), keep_unmatched=True).first()
    assert row.aligned_date == wanted


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_cutoff_over_clock_changes_and_session_zone(spark, zone):
    days = [D(2024, 3, 8), D(2024, 3, 11), D(2024, 3, 12), D(2024, 11, 1), D(2024, 11, 4), D(2024, 11, 5)]
    cases = {
        "2024-03-11 09:29:59": D(2024, 3, 11), "2024-03-11 09:30:00": D(2024, 3, 12),
        "2024-11-04 09:29:59": D(2024, 11, 4), "2024-11-04 09:30:00": D(2024, 11, 5),
        "2024-03-08 09:29:59": D(2024, 3, 8), "2024-11-01 09:30:00": D(2024, 11, 4),
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        posts = spark.createDataFrame([("A", epoch(t), t) for t in cases], "ticker string, created_utc bigint, t string")
        got = {r.t: r.aligned_date for r in align_posts(posts, sessions(spark, [("A", d) for d in days])).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == cases


def test_day_grid_bounds(spark):
    keys = spark.createDataFrame([("A",)], "ticker string")
    assert day_grid(keys, "2024-01-01", "2024-01-04").count() == 3
    assert day_grid(keys, "2024-01-01", "2024-01-04", end_exclusive=False).count() == 4
    daily = spark.createDataFrame([("A", D(2024, 1, 2), 5)], "ticker string, date date, n int")
    filled = fill_calendar(daily, keys, "2024-01-01", "2024-01-04", ["ticker"]).orderBy("date").collect()
    assert [r.n for r in filled] == [None, 5, None]


def test_rollup_means_sums_and_nulls(spark):
    rows = [
        ("A", D(2024, 1, 6), 1.0, None), ("A", D(2024, 1, 7), 2.0, None), ("A", D(2024, 1, 7), None, None),
        ("A", D(2024, 1, 8), 6.0, None), ("A", D(2024, 1, 5), None, 4.0), ("A", D(2024, 1, 9), 9.0, 9.0),
    ]
    series = spark.createDataFrame(rows, "ticker string, date date, x double, y double")
    got = {r.date.day: (r.x, r.y) for r in session_rollup(series, sessions(spark), ["x"], ["y"]).collect()}
    assert got == {5: (None, 4.0), 8: (3.0, 0.0)}


def test_dedupes(spark):
    rows = [("A", D(2024, 1, 1), 1, 10), ("A", D(2024, 1, 1), 2, 20), ("A", D(2024, 1, 2), 1, 30)]
    frame = spark.createDataFrame(rows, "ticker string, date date, w int, x int")
    first = {r.date.day: r.x for r in dedupe_dates(frame, "w", "first").collect()}
    last = {r.date.day: r.x for r in dedupe_dates(frame, "w", "last").collect()}
    assert first == {1: 10, 2: 30} and last == {1: 20, 2: 30}
    assert {r.date.day: r.x for r in mean_duplicates(frame, ["x"]).collect()} == {1: 15.0, 2: 30.0}
    with pytest.raises(ValueError):
        require_unique(frame, ["ticker", "date"])


def test_volume_tone(spark):
    volume = spark.createDataFrame([("A", D(2024, 1, 1), 5.0, 0.5)], "ticker string, date date, articles double, robust double")
    tone = spark.createDataFrame(
        [("A", D(2024, 1, 1), 1.0), ("A", D(2024, 1, 2), 2.0), ("B", D(2024, 1, 2), 3.0)],
        "ticker string, date date, tone double",
    )
    got = sorted(tuple(r) for r in join_volume_tone(volume, tone).collect())
    assert got == [("A", D(2024, 1, 1), 5.0, 0.5, 1.0), ("B", D(2024, 1, 2), 0.0, 0.0, 3.0)]


def test_plans_hold_no_nested_loop(spark):
    frame = spark.createDataFrame([("A", D(2024, 1, 6))], "ticker string, date date")
    for row_level in (False, True):
        plan = map_to_next_session(frame, sessions(spark), row_level=row_level)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
