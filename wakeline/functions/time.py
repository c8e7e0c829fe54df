"""Calendar parts of an epoch-seconds column, always in UTC whatever the session timezone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_datetime(epoch: Column | str) -> Column:
    """Naive UTC timestamp."""
    return F.timestamp_add("SECOND", _col(epoch), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def utc_date(epoch: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(_col(epoch) / F.lit(DAY)).cast("int"))


def utc_hour(epoch: Column | str) -> Column:
    return F.floor(F.pmod(_col(epoch), F.lit(DAY)) / F.lit(3600)).cast("int")


def utc_year(epoch: Column | str) -> Column:
    return F.year(utc_date(epoch))


def utc_month(epoch: Column | str) -> Column:
    return F.month(utc_date(epoch))


def weekday_name(epoch: Column | str) -> Column:
    return F.date_format(utc_date(epoch), "EEEE")


def iso_year(epoch: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), utc_date(epoch)).cast("int")


def iso_week(epoch: Column | str) -> Column:
    return F.weekofyear(utc_date(epoch))


def week_start(epoch: Column | str) -> Column:
    """Monday of the week."""
    day = utc_date(epoch)
    return F.date_sub(day, F.weekday(day))
