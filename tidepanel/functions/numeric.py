"""Number parsing, counts, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def as_number(text: Column) -> Column:
    """Text to double; anything unreadable, and NaN, becomes NULL.

    Java reads a trailing type letter ("1d", "2f") as part of the number; that is no number here.
    """
    text = text.cast("string")
    value = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.nanvl(value, missing())


def known(x: Column) -> Column:
    """A double with NaN turned into NULL, the only missing value used downstream."""
    return F.nanvl(x.cast("double"), missing())


def count_or_zero(x: Column) -> Column:
    return F.greatest(F.coalesce(known(x), F.lit(0.0)), F.lit(0.0))


def engagement_weight(score: Column, comments: Column) -> Column:
    """1 + ln(1 + score) + ln(1 + comments), both clamped at zero."""
    return F.lit(1.0) + F.log1p(count_or_zero(score)) + F.log1p(count_or_zero(comments))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def softmax_difference(logits: list[Column], positive: int, negative: int) -> Column:
    """Probability of one class minus another, shifted by the maximum so that exp cannot overflow."""
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return (parts[positive] - parts[negative]) / total
