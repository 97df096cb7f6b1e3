"""Windows, targets and splits against pandas and by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidepanel.operators import features as fx
from tidepanel.operators.split import date_split, split_map, walk_forward

START = dt.date(2024, 1, 1)


def series(spark, values, key="A", name="x"):
    rows = [(key, START + dt.timedelta(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ticker string, date date, {name} double")


def column(frame, name):
    return [r[name] for r in frame.orderBy("ticker", "date").collect()]


def same(got, wanted):
    for a, b in zip(got, wanted, strict=True):
        if b is None or pd.isna(b) or np.isinf(b):
            assert a is None
        else:
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


values = st.lists(st.one_of(st.none(), st.integers(1, 1000)), min_size=1, max_size=45)


@settings(max_examples=8, deadline=None)
@given(values, st.integers(2, 6))
def test_trailing_windows_match_pandas(spark, xs, rows):
    xs = [None if x is None else float(x) for x in xs]
    s = pd.Series(xs, dtype=float)
    mean, std = s.shift(1).rolling(rows).mean(), s.shift(1).rolling(rows).std()
    w = fx.over()
    frame = series(spark, xs).select(
        "ticker", "date",
        fx.zscore(F.col("x"), rows, w).alias("z"), fx.trailing_std(F.col("x"), rows, w).alias("s"),
        fx.change(F.col("x"), 2, w).alias("c"), fx.next_return(F.col("x"), 1, w).alias("n"),
    )
    # pandas' online variance leaves residue on constant windows; those are NULL here.
    exact = [len(set(xs[max(i - rows, 0):i])) > 1 for i in range(len(xs))]
    z = (s - mean) / std.where(exact, np.nan)
    same(column(frame, "z"), z)
    same([a for a, ok in zip(column(frame, "s"), exact) if ok], [b for b, ok in zip(std, exact) if ok])
    same(column(frame, "c"), s / s.shift(2) - 1)
    same(column(frame, "n"), s.shift(-1) / s - 1)


def test_null_breaks_and_refills_a_window(spark):
    xs = [float(i % 7) for i in range(31)]
    xs[10] = None
    got = column(fx.with_zscores(series(spark, xs), {"z": ("x", 5)}), "z")
    assert all(v is None for v in got[:5]) and got[5] is not None
    assert all(v is None for v in got[10:16]) and got[16] is not None


def test_constant_and_short_windows(spark):
    assert column(fx.with_zscores(series(spark, [3.0] * 30), {"z": ("x", 20)}), "z") == [None] * 30
    assert column(fx.with_zscores(series(spark, [1.0, 2.0, 3.0]), {"z": ("x", 20)}), "z") == [None] * 3


def test_keys_do_not_mix(spark):
    both = series(spark, [1.0, 2.0]).unionByName(series(spark, [10.0, 5.0], "B"))
    got = column(both.withColumn("c", fx.change(F.col("x"), 1, fx.over())), "c")
    assert got == [None, 1.0, None, -0.5]


def test_band_edges_are_strict(spark):
    frame = spark.createDataFrame([(0.5,), (0.500001,), (-0.5,), (-0.6,), (None,)], "r double")
    r = F.col("r")
    got = frame.select(fx.banded(r, 0.5).alias("t"), fx.three_class(r, 0.5).alias("c")).collect()
    assert [x.t for x in got] == [None, 1, None, 0, None]
    assert [x.c for x in got] == [1, 2, 1, 0, None]


def test_target_flags(spark):
    frame = fx.with_target(series(spark, [100.0, 100.0, 110.0], name="stock_price"), 0.05)
    got = frame.orderBy("date").select("target", "target_available", "is_neutral").collect()
    assert [tuple(r) for r in got] == [(None, True, True), (1, True, False), (None, False, False)]
    assert fx.labelled(frame).count() == 1


def test_documented_variants(spark):
    frame = series(spark, [1.0, None, -4.0, 2.0])
    assert column(fx.with_lags(frame, "x", [2]), "x_lag_2") == [None, None, 1.0, None]
    assert column(fx.with_delta(frame, "x"), "x_direction_1") == [None, None, None, 1]
    flags = fx.with_presence(frame, "x")
    assert column(flags, "x_present") == [1, 0, 0, 1] and column(flags, "x_missing") == [0, 1, 0, 0]
    assert column(flags, "x_present_lag_1") == [None, 1, 0, 0]
    assert column(frame.withColumn("p", fx.prior_filled(F.col("x"), fx.over())), "p") == [1.0, 1.0, -4.0, 2.0]
    classes = column(frame.withColumn("k", fx.sentiment_class(F.col("x"))), "k")
    assert classes == ["positive", None, "negative", "positive"]


def test_feature_frame_sorts_once_per_key(spark):
    base = series(spark, [float(i) for i in range(40)], name="stock_price").withColumn("v", F.col("stock_price"))
    made = fx.feature_frame(base, zscores={"vz": ("v", 20), "pz": ("stock_price", 30)}, zero_filled=["v"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort [") + plan.count(": Sort [") == 1


def blocks(n, **kwargs):
    return lambda spark: {
        r.split: (r.a, r.b) for r in split_map(series(spark, [0.0] * n), **kwargs)
        .groupBy("split").agg(
            F.min(F.datediff("date", F.lit(START))).alias("a"), F.max(F.datediff("date", F.lit(START))).alias("b")
        ).collect()
    }


def test_split_of_a_hundred_dates(spark):
    got = blocks(100)(spark)
    assert got == {"train": (0, 57), "validation": (59, 78), "test": (80, 99)}


def test_split_refuses_too_few_dates(spark):
    for n in (1, 2, 4):
        with pytest.raises(PySparkException):
            blocks(n)(spark)


def test_few_dates_are_split_when_asked(spark):
    assert blocks(1, refuse=False)(spark) == {"train": (0, 0)}
    assert blocks(2, refuse=False)(spark) == {"train": (0, 0), "test": (1, 1)}
    assert blocks(4, refuse=False)(spark) == {"train": (0, 0), "validation": (1, 1), "test": (3, 3)}
    assert blocks(100, refuse=False)(spark) == blocks(100)(spark)


@settings(max_examples=8, deadline=None)
@given(st.integers(40, 200), st.integers(0, 5))
def test_split_follows_its_arithmetic(spark, n, gap):
    t = min(max(int(np.floor(n * 0.8)), 2), n - 1)
    p = max(t - gap, 1)
    v = min(max(max(20, int(np.floor(p * 0.2))), 1), p - 1)
    train_end = max(p - v - gap, 1)
    got = blocks(n, gap=gap)(spark)
    assert got == {"train": (0, train_end - 1), "validation": (p - v, p - 1), "test": (t, n - 1)}


def test_rows_keep_one_split(spark):
    frame = series(spark, [0.0] * 60).unionByName(series(spark, [0.0] * 60, "B"))
    rows = date_split(frame)
    assert rows.groupBy("date").agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
    assert rows.filter("split = 'test'").count() == 2 * 12


def test_walk_forward_has_gaps_and_covers_the_end(spark):
    folds = walk_forward(series(spark, [0.0] * 50), folds=3, gap=2).collect()
    for k in range(3):
        train = [r.date for r in folds if r.fold == k and r.role == "train"]
        test = [r.date for r in folds if r.fold == k and r.role == "test"]
        assert (min(test) - max(train)).days == 3
    assert max(r.date for r in folds) == START + dt.timedelta(49)


def test_rank_over_known_values(spark):
    from tidepanel.operators.features import rank_within_date

    data = spark.createDataFrame([(1, None), (1, 1.0), (1, 2.0), (2, None)], "date int, x double")
    got = sorted((r.date, r.x, r.x_rank) for r in rank_within_date(data, "x").filter("x is not null").collect())
    assert got == [(1, 1.0, 0.0), (1, 2.0, 1.0)]
