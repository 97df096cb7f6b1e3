"""Trading sessions: forward as-of lookup, intraday cutoff, dense day grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import EXCHANGE_OPEN, EXCHANGE_ZONE
from tidepanel.functions.clock import local_date, local_second_of_day, seconds_of
from tidepanel.session import checked_broadcast


def sessions_of(prices: DataFrame, key: str | None = "ticker", date: str = "date") -> DataFrame:
    """Distinct trading dates, per key or for one shared calendar."""
    keys = [key] if key else []
    return prices.filter(F.col(date).isNotNull()).select(
        *keys, F.col(date).alias("session_date")
    ).distinct()


def session_index(sessions: DataFrame, key: str | None = "ticker") -> DataFrame:
    """One row per key: first session, last session, and the next session of every day between.

    A session stands for the days after the session before it, so the array over the days is dense
    and the lookup of a day is plain indexing. The array has one entry per calendar day of the
    key's history, whatever the number of rows that will be looked up.
    """
    keys = [key] if key else []
    order = Window.partitionBy(*keys).orderBy("session_date")
    span = sessions.select(
        *keys,
        "session_date",
        F.coalesce(
            F.datediff("session_date", F.lag("session_date").over(order)), F.lit(1)
        ).alias("days"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("session_date", "days")))
    return span.groupBy(*keys).agg(
        F.min("session_date").alias("first_session"),
        F.max("session_date").alias("last_session"),
        F.flatten(
            F.transform(ordered, lambda s: F.array_repeat(s["session_date"], s["days"]))
        ).alias("next_session"),
    )


def _lookup(day: Column, index: str | None = None) -> Column:
    first, last, dense = (
        (F.col(index)[name] if index else F.col(name))
        for name in ("first_session", "last_session", "next_session")
    )
    return (
        F.when(day > last, F.lit(None).cast("date"))
        .when(day <= first, first)
        .otherwise(F.get(dense, F.datediff(day, first)))
    )


def map_to_next_session(
    frame: DataFrame,
    sessions: DataFrame,
    day: str | Column = "date",
    key: str | None = "ticker",
    output: str = "session_date",
    tolerance_days: int | None = None,
    keep_unmatched: bool = False,
    row_level: bool = False,
) -> DataFrame:
    """Forward as-of join: every day gets the same or next session of its key.

    Days before the first session go to it (limit that with ``tolerance_days``); days after the
    last one match nothing and are dropped unless kept. With a shared calendar (``key=None``) the
    index is a scalar subquery and no join is planned. With a key it is one equi-join; set
    ``row_level`` when ``frame`` holds many rows per day, to broadcast the index if its counted
    size allows and so keep a hot key from being shuffled.
    """
    day = F.col(day) if isinstance(day, str) else day
    index = session_index(sessions, key)
    names = ["first_session", "last_session", "next_session"]
    if key is None:
        joined = frame.withColumn("_index", index.select(F.struct(*names)).scalar())
        found, extra = _lookup(day, "_index"), ["_index"]
    else:
        # An index row is one date per day of history: 16 KiB covers some eleven years.
        side = checked_broadcast(index, row_bytes=16 * 1024) if row_level else index
        joined = frame.join(side, key, "left" if keep_unmatched else "inner")
        found, extra = _lookup(day), names
    if tolerance_days is not None:
        found = F.when(F.datediff(found, day) <= tolerance_days, found)
    mapped = joined.withColumn(output, found).drop(*extra)
    return mapped if keep_unmatched else mapped.filter(F.col(output).isNotNull())


def probe_day(epoch: Column, zone: str = EXCHANGE_ZONE, opens: str = EXCHANGE_OPEN) -> Column:
    """The day to look a post up under: its local day strictly before the open, else the day after."""
    late = local_second_of_day(epoch, zone) >= F.lit(seconds_of(opens))
    return F.date_add(local_date(epoch, zone), late.cast("int"))


def align_posts(
    posts: DataFrame,
    sessions: DataFrame,
    epoch: str = "created_utc",
    key: str | None = "ticker",
    output: str = "aligned_date",
    zone: str = EXCHANGE_ZONE,
    opens: str = EXCHANGE_OPEN,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Session on which a post could first be traded on: same day before the open, else the next.

    A day without a session maps forward either way, so the cutoff is only a day shift in front
    of the as-of lookup.
    """
    return map_to_next_session(
        posts, sessions, probe_day(F.col(epoch), zone, opens), key, output,
        keep_unmatched=keep_unmatched, row_level=True,
    )


def day_grid(keys: DataFrame, start, end, end_exclusive: bool = True) -> DataFrame:
    """Every key with every calendar day; the last day is left out unless asked for."""
    last = F.lit(end).cast("date")
    days = F.sequence(
        F.lit(start).cast("date"), F.date_sub(last, 1) if end_exclusive else last
    )
    return keys.withColumn("date", F.explode(days))


def fill_calendar(
    metrics: DataFrame, keys: DataFrame, start, end, on: list[str], end_exclusive: bool = True
) -> DataFrame:
    """Left-join metrics onto the dense day grid of the keys."""
    return day_grid(keys.distinct(), start, end, end_exclusive).join(metrics, [*on, "date"], "left")
