"""Plans of what to land: request windows, missing windows, placeholder days, keys, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import DEFAULT_COMPANY, DEFAULT_TICKER


def plan_windows(
    spans: DataFrame, days: int, start: str = "start", end: str = "end"
) -> DataFrame:
    """Cut every ``[start, end]`` into windows of ``days + 1`` days; the last one is clipped."""
    first = F.explode(
        F.sequence(F.col(start), F.col(end), F.make_dt_interval(F.lit(days + 1)))
    )
    rest = [c for c in spans.columns if c not in (start, end)]
    return (
        spans.filter(F.col(start) <= F.col(end))
        .select(*rest, F.col(end).alias("_end"), first.alias("_first"))
        .select(
            *rest,
            F.col("_first").cast("date").alias("window_start"),
            F.least(F.date_add(F.col("_first").cast("date"), days), "_end").alias("window_end"),
        )
    )


def missing_windows(planned: DataFrame, landed: DataFrame, on: list[str]) -> DataFrame:
    """Planned windows without a landed file."""
    return planned.join(landed.select(*on).distinct(), on, "left_anti")


def placeholder_days(windows: DataFrame, value: str) -> DataFrame:
    """One row per day of a window that brought no data, with a NULL value."""
    rest = [c for c in windows.columns if c not in ("window_start", "window_end")]
    return windows.select(
        *rest,
        F.explode(F.sequence("window_start", "window_end")).alias("date"),
        F.lit(None).cast("double").alias(value),
    )


def split_keys(lists: DataFrame, text: str, source: str) -> DataFrame:
    """Keys of free-text lists: split on blanks and commas, upper case, blanks dropped.

    ``source`` ranks the lists (group first, then list, then single key). The result keeps each key
    once, at its first position.
    """
    parts = lists.select(source, F.posexplode(F.split(F.upper(F.trim(text)), r"[\s,]+")))
    return (
        parts.filter(F.length("col") > 0)
        .groupBy(F.col("col").alias("ticker"))
        .agg(F.min(F.struct(F.col(source), F.col("pos"))).alias("at"))
        .select("ticker", F.col(f"at.{source}").alias(source), F.col("at.pos").alias("position"))
    )


def without_keys(frame: DataFrame, excluded: DataFrame, key: str = "ticker") -> DataFrame:
    """Anti-join on the excluded keys."""
    return frame.join(excluded.select(key).distinct(), key, "left_anti")


def _given(x: Column) -> Column:
    trimmed = F.trim(x)
    return F.when(F.length(trimmed) > 0, trimmed)


def resolve_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Fill company and query texts: the explicit value, else the profile's, else a default.

    ``requests`` is (ticker, company_name, trends_query, gdelt_query), any of the last three NULL;
    further columns are kept.
    An explicit value wins even when blank. A blank search query then falls back to the company, a
    blank news query to ``(company OR ticker)``, or ``(ticker)`` where both are the same.
    """
    asked = requests.withColumn("ticker", F.upper(F.trim("ticker")))
    texts = ("company_name", "trends_query", "gdelt_query")
    rest = [c for c in requests.columns if c not in ("ticker", *texts)]
    known = profiles.select(
        "ticker",
        *[F.col(c).alias(f"_{c}") for c in texts],
    )
    joined = asked.join(known, "ticker", "left")
    default = F.when(F.col("ticker") == DEFAULT_TICKER, F.lit(DEFAULT_COMPANY)).otherwise(
        F.col("ticker")
    )
    company = F.coalesce(F.trim("company_name"), "_company_name", default)
    both = F.concat(F.lit("("), company, F.lit(" OR "), F.col("ticker"), F.lit(")"))
    alone = F.concat(F.lit("("), F.col("ticker"), F.lit(")"))
    return joined.select(
        "ticker",
        *rest,
        company.alias("company_name"),
        F.coalesce(_given(F.coalesce("trends_query", "_trends_query")), company).alias(
            "trends_query"
        ),
        F.coalesce(
            _given(F.coalesce("gdelt_query", "_gdelt_query")),
            F.when(F.upper(F.trim(company)) == F.col("ticker"), alone).otherwise(both),
        ).alias("gdelt_query"),
    )


def is_default_profile(ticker: Column, company: Column, tag: Column) -> Column:
    """True for the default ticker and company without a tag: such outputs keep the bare name."""
    return (
        (F.upper(ticker) == DEFAULT_TICKER)
        & (F.lower(F.trim(company)) == DEFAULT_COMPANY.lower())
        & (F.length(F.trim(F.coalesce(tag, F.lit("")))) == 0)
    )
