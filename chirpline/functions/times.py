"""Points in time as Columns, independent of the session's time zone."""

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

MICROS = 1_000_000
DAY_SECONDS = 86_400


def moment(value) -> Column:
    """A Column from a Column, a datetime (no zone means UTC) or an ISO string."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        delta = value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
        micros = (delta.days * DAY_SECONDS + delta.seconds) * MICROS + delta.microseconds
        return F.timestamp_micros(F.lit(micros))
    return F.lit(value).cast("timestamp")


def latest(df: DataFrame, column: str = "timestamp") -> Column:
    """The latest time of a table as a scalar subquery: no join, no trip through the driver."""
    return df.agg(F.max(column).alias("latest")).scalar()


def minus_seconds(at: Column, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(at) - F.lit(int(seconds * MICROS)))


def age_seconds(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(float(MICROS))


def utc_date(at: Column) -> Column:
    days = F.floor(F.unix_seconds(at) / F.lit(DAY_SECONDS))
    return F.date_from_unix_date(days.cast("int"))
