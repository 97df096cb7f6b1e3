"""Dates and exchange-local times from epoch seconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def seconds_of(clock: str) -> int:
    """'09:30:00' as seconds of the day."""
    hours, minutes, *rest = (int(part) for part in clock.split(":"))
    return hours * 3600 + minutes * 60 + (rest[0] if rest else 0)


def _day(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / F.lit(DAY)).cast("int"))


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds from "1704895800", "1704895800.0" or a number; NULL if unreadable."""
    number = text.cast("string").try_cast("double")
    return F.coalesce(text.cast("string").try_cast("bigint"), number.try_cast("bigint"))


def utc_date(epoch: Column) -> Column:
    return _day(epoch.cast("bigint"))


def local_seconds(epoch: Column, zone: str) -> Column:
    """Wall-clock seconds in the zone, counted as if the wall clock were UTC."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(epoch.cast("bigint")), zone))


def local_date(epoch: Column, zone: str) -> Column:
    return _day(local_seconds(epoch, zone))


def local_second_of_day(epoch: Column, zone: str) -> Column:
    return F.pmod(local_seconds(epoch, zone), F.lit(DAY)).cast("int")


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def parse_date(text: Column, formats: tuple[str, ...] = ()) -> Column:
    """ISO date or timestamp text, or one of the extra formats, as a date; NULL if unreadable."""
    text = F.trim(text.cast("string"))
    tries = [F.to_date(text.try_cast("timestamp_ntz"))]
    tries += [F.to_date(F.try_to_timestamp(text, F.lit(form))) for form in formats]
    return F.coalesce(*tries)
