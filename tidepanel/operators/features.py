"""Trailing-window features, targets, flags, and the documented feature variants.

All windows run over (key, date)-unique frames, so a window partition holds at most one row per
calendar day of a key; ``mean_duplicates`` or ``session_rollup`` make that so. Rows count, not
days, and a window is full only if every one of its values is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.contract import NEUTRAL_BAND, ZSCORES
from tidepanel.functions.numeric import ratio


def over(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """x / x n rows earlier - 1, without filling gaps."""
    return ratio(x, F.lag(x, n).over(w)) - 1.0


def full(x: Column, rows: int, w: WindowSpec) -> tuple[WindowSpec, Column]:
    """Frame of the rows before the current one, and whether all of them are known."""
    frame = w.rowsBetween(-rows, -1)
    return frame, F.count(x).over(frame) == rows


def trailing_std(x: Column, rows: int, w: WindowSpec) -> Column:
    frame, ok = full(x, rows, w)
    return F.when(ok, F.stddev_samp(x).over(frame))


def trailing_mean(x: Column, rows: int, w: WindowSpec) -> Column:
    frame, ok = full(x, rows, w)
    return F.when(ok, F.avg(x).over(frame))


def zscore(x: Column, rows: int, w: WindowSpec) -> Column:
    """(x - mean before) / std before; NULL for a constant or incomplete window."""
    frame, ok = full(x, rows, w)
    spread = F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0))
    return F.when(ok, (x - F.avg(x).over(frame)) / spread)


def next_return(price: Column, rows: int, w: WindowSpec) -> Column:
    return ratio(F.lead(price, rows).over(w), price) - 1.0


def banded(r: Column, band: float) -> Column:
    """1 above the band, 0 below its negative, NULL inside or unknown. Both sides strict."""
    return F.when(r < -band, F.lit(0)).when(r > band, F.lit(1))


def three_class(r: Column, band: float) -> Column:
    """0 down, 1 neutral, 2 up."""
    return F.when(r < -band, F.lit(0)).when(r > band, F.lit(2)).when(r.isNotNull(), F.lit(1))


def zero_fill(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Sparse sentiments and counts: NULL becomes 0."""
    return frame.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def with_returns(frame: DataFrame, lags: list[int] = (1, 5, 20), price: str = "stock_price") -> DataFrame:
    w = over()
    return frame.withColumns({f"return_{n}d": change(F.col(price), n, w) for n in lags})


def with_zscores(frame: DataFrame, zscores: dict[str, tuple[str, int]] = ZSCORES) -> DataFrame:
    w = over()
    return frame.withColumns({out: zscore(F.col(x), rows, w) for out, (x, rows) in zscores.items()})


def with_target(
    frame: DataFrame, band: float = NEUTRAL_BAND, horizon: int = 1, price: str = "stock_price"
) -> DataFrame:
    """Next return, banded target and its flags."""
    future = f"future_return_{horizon}d"
    r = F.col(future)
    return frame.withColumn(future, next_return(F.col(price), horizon, over())).withColumns(
        {
            "target": banded(r, band),
            "target_available": r.isNotNull(),
            "is_neutral": r.isNotNull() & F.coalesce(F.abs(r) <= band, F.lit(False)),
        }
    )


def feature_frame(
    panel: DataFrame,
    band: float = NEUTRAL_BAND,
    zscores: dict[str, tuple[str, int]] = ZSCORES,
    zero_filled: list[str] = ("comm_reddit_vader_mean", "comm_reddit_posts"),
) -> DataFrame:
    """Panel plus returns, volatility, z-scores and target: one shuffle and one sort per key."""
    returns = with_returns(zero_fill(panel, list(zero_filled)))
    w = over()
    wide = returns.withColumns(
        {"rolling_volatility_20d": trailing_std(F.col("return_1d"), 20, w)}
        | {out: zscore(F.col(x), rows, w) for out, (x, rows) in zscores.items()}
    )
    return with_target(wide, band)


def labelled(frame: DataFrame, target: str = "target") -> DataFrame:
    """Only rows with a target of 0 or 1, as an integer."""
    return frame.filter(F.col(target).isin(0, 1)).withColumn(target, F.col(target).cast("int"))


# --- variants named in the documentation; semantics below that level are this package's ---------


def with_lags(frame: DataFrame, column: str, lags: list[int]) -> DataFrame:
    w = over()
    return frame.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(w) for k in lags})


def with_lag_means(frame: DataFrame, column: str, spans: list[int]) -> DataFrame:
    """Mean of the lags 1..k."""
    w = over()
    return frame.withColumns(
        {f"{column}_mean_lag_1_{k}": trailing_mean(F.col(column), k, w) for k in spans}
    )


def with_gap_and_surprise(frame: DataFrame, column: str, rows: int) -> DataFrame:
    """Distance to the trailing mean, raw and in trailing standard deviations."""
    w, x = over(), F.col(column)
    return frame.withColumns(
        {
            f"{column}_gap_{rows}": x - trailing_mean(x, rows, w),
            f"{column}_surprise_{rows}": zscore(x, rows, w),
        }
    )


def with_delta(frame: DataFrame, column: str) -> DataFrame:
    """Row-on-row difference and its sign."""
    delta = F.col(column) - F.lag(column, 1).over(over())
    return frame.withColumns(
        {f"{column}_delta_1": delta, f"{column}_direction_1": F.signum(delta).cast("int")}
    )


def with_presence(frame: DataFrame, column: str, lags: list[int] = (1, 2)) -> DataFrame:
    """Flags: present (above zero), missing, and lags of presence."""
    w = over()
    present = F.coalesce(F.col(column) > 0, F.lit(False)).cast("int")
    flags = {f"{column}_present": present, f"{column}_missing": F.col(column).isNull().cast("int")}
    return frame.withColumns(
        flags | {f"{column}_present_lag_{k}": F.lag(present, k).over(w) for k in lags}
    )


def sentiment_class(x: Column, threshold: float = 0.05) -> Column:
    return (
        F.when(x >= threshold, "positive").when(x <= -threshold, "negative")
        .when(x.isNotNull(), "neutral")
    )


def prior_filled(x: Column, w: WindowSpec, neutral: float = 0.0) -> Column:
    """x, else the mean of the key's known values so far, else neutral."""
    so_far = F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(x, so_far, F.lit(neutral))


def band_sweep(frame: DataFrame, bands: list[float], r: str = "future_return_1d") -> DataFrame:
    """Class counts for every band from one aggregate: conditional counts, no row is repeated."""
    x = F.col(r)
    parts = [
        F.struct(
            F.lit(float(b)).alias("band"),
            F.count_if(x < -b).alias("n_down"),
            F.count_if(F.abs(x) <= b).alias("n_neutral"),
            F.count_if(x > b).alias("n_up"),
        )
        for b in bands
    ]
    return frame.agg(F.array(*parts).alias("bands")).select(F.inline("bands"))


def rank_within_date(frame: DataFrame, column: str, date: str = "date") -> DataFrame:
    """Share of the date's other known values that rank below, 0 to 1; a date holds one row per key."""
    w = Window.partitionBy(date, F.col(column).isNull()).orderBy(column)
    return frame.withColumn(
        f"{column}_rank", F.when(F.col(column).isNotNull(), F.percent_rank().over(w))
    )
