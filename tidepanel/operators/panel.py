"""Daily series to one row per (key, session): roll-ups, dedupes, the panel joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import PANEL_COLUMNS, POST_METRICS
from tidepanel.functions.numeric import ratio
from tidepanel.operators.calendar import map_to_next_session


def session_rollup(
    series: DataFrame,
    sessions: DataFrame,
    means: list[str] = (),
    sums: list[str] = (),
    key: str = "ticker",
    tolerance_days: int | None = None,
) -> DataFrame:
    """Roll calendar days up to sessions: means over the known rows, sums with NULL as zero.

    Rows are first reduced to sums and counts per (key, day) - combined on the map side - so what
    meets the session index and the second aggregate has at most one row per key and day, however
    many rows a key holds.
    """
    parts = []
    for c in means:
        parts += [F.sum(c).alias(f"{c}__sum"), F.count(c).alias(f"{c}__n")]
    parts += [F.sum(c).alias(f"{c}__total") for c in sums]
    daily = series.groupBy(key, "date").agg(*parts)
    mapped = map_to_next_session(daily, sessions, "date", key, tolerance_days=tolerance_days)
    finals = [ratio(F.sum(f"{c}__sum"), F.sum(f"{c}__n")).alias(c) for c in means]
    finals += [F.coalesce(F.sum(f"{c}__total"), F.lit(0.0)).alias(c) for c in sums]
    return (
        mapped.groupBy(key, "session_date").agg(*finals).withColumnRenamed("session_date", "date")
    )


def mean_duplicates(series: DataFrame, values: list[str], key: str = "ticker") -> DataFrame:
    """Collapse duplicate dates of a key by the mean of the known values."""
    return series.groupBy(key, "date").agg(*[F.avg(c).alias(c) for c in values])


def dedupe_dates(
    series: DataFrame, order: str, keep: str = "first", key: list[str] = ("ticker",)
) -> DataFrame:
    """One row per (key, date) out of stitched windows: the first or the last by window start.

    An aggregate rather than a row number: it combines on the map side and needs no sort.
    """
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    rest = [c for c in series.columns if c not in (*key, "date")]
    return (
        series.groupBy(*key, "date")
        .agg(pick(F.struct(*rest), F.col(order)).alias("_kept"))
        .select(*key, "date", *[F.col("_kept")[c].alias(c) for c in rest])
    )


def join_volume_tone(volume: DataFrame, tone: DataFrame, key: str = "ticker") -> DataFrame:
    """News volume with its tone by date.

    ``volume`` is (key, date, articles, robust), ``tone`` (key, date, tone). Dates come from the
    volume; a key without any volume takes its tone dates with zero volume and zero score.
    """
    with_volume = volume.select(key).distinct()
    only_tone = tone.join(with_volume, key, "left_anti").select(
        key, "date", F.lit(0.0).alias("articles"), F.lit(0.0).alias("robust"), "tone"
    )
    return volume.join(tone, [key, "date"], "left").select(
        key, "date", "articles", "robust", "tone"
    ).unionByName(only_tone)


def prefix_metrics(daily: DataFrame, prefix: str, metrics: list[str] = POST_METRICS) -> DataFrame:
    """Put the kind of post in front of its metric names."""
    return daily.withColumnsRenamed({c: f"{prefix}_{c}" for c in metrics})


def join_panel(
    prices: DataFrame,
    submissions: DataFrame,
    comments: DataFrame,
    search: DataFrame,
    news: DataFrame,
    key: str = "ticker",
    order: list[str] = PANEL_COLUMNS,
) -> DataFrame:
    """All daily sides onto the prices, all keys in one plan, columns in contract order.

    Every side is unique on (key, date), so the five-way join shuffles each side once on the same
    keys and multiplies nothing. Use ``require_unique`` where a side is not made by this package.
    """
    panel = prices
    for side in (submissions, comments, search, news):
        panel = panel.join(side, [key, "date"], "left")
    return panel.select(*order)


def require_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Fail if a key combination repeats; otherwise pass the frame on."""
    twice = frame.groupBy(*keys).count().filter("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"rows are not unique on {keys}: {twice.first()}")
    return frame
