"""Audits, summaries, the metadata document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.contract import ALIGNMENT_POLICY
from tidepanel.functions.clock import iso


def source_audit(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Per (ticker, source): chosen file, fallback flag, rows, first and last date.

    ``chosen`` is (ticker, source_name, selected_file, used_fallback); ``rows`` the daily rows of
    the chosen files as (ticker, source_name, date). A source without a file has 0 and NULLs.
    """
    counts = rows.groupBy("ticker", "source_name").agg(
        F.count("date").alias("rows"),
        iso(F.min("date")).alias("date_min"),
        iso(F.max("date")).alias("date_max"),
    )
    return chosen.join(counts, ["ticker", "source_name"], "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("bigint"))
    )


def coverage_audit(
    daily: DataFrame,
    kinds: list[str],
    key: str = "ticker",
    posts: str = "reddit_posts",
    mean: str = "reddit_finbert_mean",
) -> DataFrame:
    """Per key, for each kind: days, days with posts, their share, days with NULL and zero mean."""
    some = F.coalesce(F.col(posts) > 0, F.lit(False))

    def of(kind: str, name: str, flag: Column) -> Column:
        return F.count_if((F.col("kind") == kind) & flag).alias(f"{kind}_{name}")

    columns = []
    for kind in kinds:
        here = F.col("kind") == kind
        columns += [
            of(kind, "days", F.lit(True)),
            of(kind, "days_with_posts", some),
            F.avg(F.when(here, some.cast("double"))).alias(f"{kind}_post_coverage"),
            of(kind, "finbert_null_days", F.col(mean).isNull()),
            of(kind, "finbert_zero_days", F.coalesce(F.col(mean) == 0, F.lit(False))),
        ]
    return daily.groupBy(key).agg(*columns)


def panel_summary(panel: DataFrame, null_rates: dict[str, str], key: str = "ticker") -> DataFrame:
    """Rows, keys, date range and null rates as (metric, value) text rows, from one aggregate."""
    parts = {
        "rows": F.count(F.lit(1)).cast("string"),
        "tickers": F.count_distinct(key).cast("string"),
        "date_min": iso(F.min("date")),
        "date_max": iso(F.max("date")),
    }
    for name, column in null_rates.items():
        rate = F.round(F.avg(F.col(column).isNull().cast("double")), 6)
        parts[name] = rate.cast("string")
    one = panel.agg(*[value.alias(name) for name, value in parts.items()])
    return one.unpivot([], list(parts), "metric", "value")


def split_summary(frame: DataFrame, split: str = "split", date: str = "date") -> DataFrame:
    return frame.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(date).alias("n_dates"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
    )


def metadata_document(
    panel: DataFrame,
    sources: DataFrame,
    coverage: DataFrame,
    paths: dict[str, str] | None = None,
    notes: list[str] = (),
    policy: str = ALIGNMENT_POLICY,
    key: str = "ticker",
) -> DataFrame:
    """One row: policy, counts, sorted keys, paths, notes and the nested audit records.

    The document holds audit records, a row per key and source, not data rows. ``metadata_records``
    gives the same records one per row.
    """

    def nested(audit: DataFrame) -> Column:
        return audit.agg(F.array_sort(F.collect_list(F.struct(*audit.columns)))).scalar()

    extra = [F.lit(value).alias(name) for name, value in (paths or {}).items()]
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_sort(F.collect_set(key)).alias("tickers_included"),
    ).select(
        F.lit(policy).alias("alignment_policy"),
        "rows",
        "tickers_included",
        *extra,
        F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("notes"),
        nested(sources).alias("raw_source_rows"),
        nested(coverage).alias("coverage_rows"),
    )


def metadata_records(sources: DataFrame, coverage: DataFrame) -> DataFrame:
    """The audit records as one JSON text per row, for any number of keys."""
    return sources.select(
        F.lit("raw_source_rows").alias("section"), "ticker", F.to_json(F.struct(*sources.columns)).alias("record")
    ).unionByName(
        coverage.select(
            F.lit("coverage_rows").alias("section"), "ticker",
            F.to_json(F.struct(*coverage.columns)).alias("record"),
        )
    )
