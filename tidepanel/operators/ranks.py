"""Cumulative counts and exact quantiles over any number of values, without a global window.

Values are first reduced to distinct values with counts, so ties and hot values cost one row. The
value range is then cut at approximate quantiles, as many as the rows need; each (group, range) is one window
partition, and the sums of the ranges before it - a table of groups x ranges rows - are added.
Cut points only spread the work: any cuts give the same result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import durable

#: Distinct values that one range should hold at most.
RANGE_ROWS = 1_000_000


def _cuts(counts: DataFrame, value: str) -> list[float]:
    """Range bounds from approximate quantiles of all distinct values: a few numbers, on the driver."""
    # Several ranges per shuffle partition even out how they hash.
    wanted = max(
        4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // RANGE_ROWS)
    )
    probabilities = [k / wanted for k in range(1, wanted)]
    found = counts.stat.approxQuantile(value, probabilities, 0.25 / wanted)
    return sorted(set(found))


def cumulative(
    counts: DataFrame, by: list[str], value: str, measures: list[str], lineage_cut: bool = True
) -> DataFrame:
    """Add ``<m>_below`` (sum over smaller values) and ``<m>_all`` (sum over the group).

    ``counts`` is unique on (by, value) and its value is a known double. It is read several times,
    so its lineage is cut first unless the caller did.
    """
    counts = durable(counts) if lineage_cut else counts
    cuts = _cuts(counts, value)
    if cuts:
        splits = [-float("inf"), *cuts, float("inf")]
        ranged = Bucketizer(splits=splits, inputCol=value, outputCol="_range").transform(counts)
        ranged = ranged.withColumn("_range", F.col("_range").cast("int"))
    else:  # no values
        ranged = counts.withColumn("_range", F.lit(0))

    whole = Window.partitionBy(*by)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # A hash join on the window's own keys: values are shuffled once and sorted once.
    return ranged.join(offsets.hint("shuffle_hash"), [*by, "_range"]).select(
        *counts.columns,
        *[
            (F.col(f"_{m}_offset") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"{m}_below")
            for m in measures
        ],
        *[f"{m}_all" for m in measures],
    )


def exact_quantiles(
    frame: DataFrame, columns: list[str], probabilities: list[float]
) -> DataFrame:
    """Linearly interpolated quantiles of several columns: (feature, probability, quantile).

    Unlike ``percentile`` it holds no column's values in one task.
    """
    long = frame.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                    for c in columns
                ]
            )
        )
    ).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("m"))
    ranked = cumulative(counts, ["feature"], "x", ["m"])
    parts = []
    for p in probabilities:
        at = (F.col("m_all") - 1) * F.lit(float(p))
        for name, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            holds = (F.col("m_below") <= rank) & (rank < F.col("m_below") + F.col("m"))
            parts.append(F.max(F.when(holds, F.col("x"))).alias(f"{name}_{p}"))
    picked = ranked.groupBy("feature").agg(F.max("m_all").alias("n"), *parts)
    made = []
    for p in probabilities:
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"`low_{p}`"), F.col(f"`high_{p}`")
        made.append(
            F.struct(
                F.lit(float(p)).alias("probability"),
                (low + (high - low) * (at - F.floor(at))).alias("quantile"),
            )
        )
    return picked.select("feature", F.inline(F.array(*made)))
