"""Scaling, imputation, class weights, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.operators.ranks import exact_quantiles


def robust_scale(
    series: DataFrame,
    value: str,
    output: str,
    key: str = "ticker",
    fit_where: Column | None = None,
    approximate: bool = False,
) -> DataFrame:
    """(x - median) / IQR per key; an IQR of zero divides by one.

    Quartiles interpolate linearly. They are computed as a whole-partition window, so the rows are
    shuffled once and not joined back; a key holds one row per day. For keys without such a bound
    set ``approximate``: the quartiles then come from a mergeable sketch, joined on the key.
    """
    fitted = F.col(value) if fit_where is None else F.when(fit_where, F.col(value))
    levels = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    if approximate:
        sketch = series.groupBy(key).agg(
            F.percentile_approx(fitted, [0.25, 0.5, 0.75], 10_000).alias("_q")
        )
        with_q = series.join(sketch, key)
    else:
        with_q = series.withColumn(
            "_q", F.percentile(fitted, levels).over(Window.partitionBy(key))
        )
    spread = F.col("_q")[2] - F.col("_q")[0]
    scale = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
    return with_q.withColumn(output, (F.col(value) - F.col("_q")[1]) / scale).drop("_q")


def medians(frame: DataFrame, columns: list[str], unknown: float | None = 0.0) -> dict[str, float | None]:
    """Exact medians of the columns: one number each, on the driver; ``unknown`` for a column without values."""
    rows = exact_quantiles(frame, columns, [0.5]).collect()
    found = {row["feature"]: row["quantile"] for row in rows}
    return {c: found.get(c, unknown) for c in columns}


def impute(frame: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None})


def moments(frame: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of the columns from one aggregate."""
    parts = []
    for k, c in enumerate(columns):
        parts += [F.avg(c).alias(f"m{k}"), F.stddev_pop(c).alias(f"s{k}")]
    row = frame.agg(*parts).first()
    return {c: (row[f"m{k}"], row[f"s{k}"]) for k, c in enumerate(columns)}


def standardize(frame: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / population std with fitted numbers; a std of zero divides by one."""
    return frame.withColumns(
        {c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in stats.items()}
    )


def standardize_lazily(frame: DataFrame, columns: list[str], fit_where: Column) -> DataFrame:
    """The same as one plan: the statistics are a scalar subquery, so the rows are not shuffled."""
    fitted = frame.filter(fit_where).agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_m") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_s") for c in columns],
        ).alias("s")
    )
    with_stats = frame.withColumn("_s", fitted.scalar())
    made = {}
    for c in columns:
        spread = F.col("_s")[f"{c}_s"]
        scale = F.when(spread == 0, F.lit(1.0)).otherwise(spread)
        made[c] = (F.col(c) - F.col("_s")[f"{c}_m"]) / scale
    return with_stats.withColumns(made).drop("_s")


def class_weights(frame: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weight n_all / (classes * n)."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    )


def with_class_weights(frame: DataFrame, label: str = "label", output: str = "weight") -> DataFrame:
    """Rows with their balanced class weight.

    The few class weights are looked up in a scalar subquery's map; a join on the label would
    send half of all rows to one task.
    """
    weights = class_weights(frame, label).agg(
        F.map_from_entries(F.collect_list(F.struct(label, "weight")))
    )
    return frame.withColumn("_w", weights.scalar()).withColumn(
        output, F.col("_w")[F.col(label)]
    ).drop("_w")


def share_of_total(frame: DataFrame, value: str, output: str, by: list[str] = ()) -> DataFrame:
    """Value over the total, or over the total of its group.

    The grand total is a scalar subquery (a window over everything would be one task); group
    totals are an aggregate joined back.
    """
    if not by:
        total = frame.agg(F.sum(value)).scalar()
        return frame.withColumn(output, ratio(F.col(value), total))
    totals = frame.groupBy(*by).agg(F.sum(value).alias("_total"))
    return frame.join(totals, list(by)).withColumn(output, ratio(F.col(value), F.col("_total"))).drop("_total")


def in_units(x: Column, unit: float) -> Column:
    """Scale to another unit, e.g. thousands to billions with 1e6."""
    return x / F.lit(float(unit))
