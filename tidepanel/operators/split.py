"""Date-ordered train / validation / test splits with a gap, and walk-forward folds.

Splits are decided on the distinct dates alone. A table of distinct dates is bounded by the
calendar (years 1 to 9999 are 3.7 million rows of 8 bytes), which is why it may sit in one window
partition and be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.contract import GAP_DATES, MIN_VALIDATION_DATES, TEST_SIZE


def date_index(frame: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with their position ``i`` (from 0) and their number ``n``."""
    dates = frame.select(date).filter(F.col(date).isNotNull()).distinct()
    return dates.select(
        date,
        (F.row_number().over(Window.orderBy(date)) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )


def split_map(
    frame: DataFrame,
    test_size: float = TEST_SIZE,
    validation_fraction: float = 0.20,
    min_validation_dates: int = MIN_VALIDATION_DATES,
    gap: int = GAP_DATES,
    date: str = "date",
    refuse: bool = True,
) -> DataFrame:
    """(date, split) for the dates that belong to a split; gap dates belong to none.

    Fails when so few dates exist that the blocks would touch or overlap. With ``refuse`` off the clamped
    blocks are taken as they are, a date of several blocks in the first of train, validation and test: no date is
    in two splits, but there may be no gap, and no validation or test dates.
    """
    n, i = F.col("n"), F.col("i")
    at = date_index(frame, date).withColumn(
        "test_at",
        F.least(F.greatest(F.floor(n * F.lit(1.0 - test_size)), F.lit(2)), n - 1),
    ).withColumn("pretest", F.greatest(F.col("test_at") - gap, F.lit(1)))
    wanted = F.greatest(
        F.lit(min_validation_dates), F.floor(F.col("pretest") * F.lit(validation_fraction))
    )
    at = at.withColumn(
        "validation_at",
        F.col("pretest") - F.least(F.greatest(wanted, F.lit(1)), F.col("pretest") - 1),
    ).withColumn("train_end", F.greatest(F.col("validation_at") - gap, F.lit(1)))
    apart = (
        (F.col("train_end") + gap <= F.col("validation_at"))
        & (F.col("pretest") + gap <= F.col("test_at"))
        & (F.col("validation_at") < F.col("pretest"))
    )
    name = (
        F.when(i < F.col("train_end"), "train")
        .when((i >= F.col("validation_at")) & (i < F.col("pretest")), "validation")
        .when(i >= F.col("test_at"), "test")
    )
    if refuse:
        name = F.when(
            ~apart, F.raise_error(F.lit("too few dates for a split with this gap")).cast("string")
        ).otherwise(name)
    return at.select(date, name.alias("split")).filter(F.col("split").isNotNull())


def date_split(frame: DataFrame, date: str = "date", **settings) -> DataFrame:
    """Rows of the three splits with a ``split`` column, in one pass over the rows."""
    return frame.join(F.broadcast(split_map(frame, date=date, **settings)), date)


def only_split(frame: DataFrame, splits: DataFrame, names: list[str], date: str = "date") -> DataFrame:
    """Semi-join: rows whose date lies in one of the named splits."""
    dates = splits.filter(F.col("split").isin(names)).select(date)
    return frame.join(F.broadcast(dates), date, "left_semi")


def walk_forward(
    frame: DataFrame, folds: int = 3, min_train_fraction: float = 0.4, gap: int = GAP_DATES,
    date: str = "date",
) -> DataFrame:
    """(date, fold, role): equal test blocks after an expanding train block, a gap before each.

    The dates after the first ``min_train_fraction`` are cut into ``folds`` blocks; fold ``k`` is
    tested on block ``k`` and trained on everything before it, less the gap.
    """
    n, i = F.col("n"), F.col("i")
    base = F.floor(n * F.lit(min_train_fraction))
    size = F.floor((n - base) / F.lit(folds))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    start = base + F.col("fold") * size
    stop = F.when(F.col("fold") == folds - 1, n).otherwise(start + size)
    role = F.when(i < start - gap, "train").when((i >= start) & (i < stop), "test")
    return (
        date_index(frame, date).select("*", fold.alias("fold"))
        .select(date, "fold", role.alias("role"))
        .filter(F.col("role").isNotNull())
    )


def fold_rows(frame: DataFrame, folds: DataFrame, fold: int, date: str = "date") -> DataFrame:
    """Rows of one fold with their role."""
    dates = folds.filter(F.col("fold") == fold).select(date, "role")
    return frame.join(F.broadcast(dates), date)


def nested_folds(
    frame: DataFrame, outer: int = 3, inner: int = 3, min_train_fraction: float = 0.4, gap: int = GAP_DATES,
    date: str = "date",
) -> DataFrame:
    """(date, outer, inner, role): walk-forward windows, each with walk-forward folds of its own training dates.

    The outer windows are those of ``walk_forward``; ``inner`` -1 marks their own roles, train and test. Within
    the training dates of an outer window the same rule gives the inner folds, with the roles train and
    validation. So no date of an outer test block, nor of the gap before it, is in any of its inner folds.
    """
    n, i = F.col("n"), F.col("i")

    def blocks(many: Column, count: int, number: Column) -> tuple[Column, Column]:
        base = F.floor(many * F.lit(min_train_fraction))
        size = F.floor((many - base) / F.lit(count))
        start = base + number * size
        return start, F.when(number == count - 1, many).otherwise(start + size)

    start, stop = blocks(n, outer, F.col("outer"))
    windows = date_index(frame, date).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).select(
        date, "i", "outer", start.alias("_start"), stop.alias("_stop"), F.greatest(start - gap, F.lit(0)).alias("_known")
    ).withColumn("inner", F.explode(F.sequence(F.lit(-1), F.lit(inner - 1))))
    first, last = blocks(F.col("_known"), inner, F.col("inner"))
    own = F.when(i < F.col("_known"), "train").when((i >= F.col("_start")) & (i < F.col("_stop")), "test")
    nested = F.when(i < first - gap, "train").when((i >= first) & (i < last), "validation")
    role = F.when(F.col("inner") < 0, own).otherwise(nested)
    return windows.select(date, "outer", "inner", role.alias("role")).filter(F.col("role").isNotNull())
