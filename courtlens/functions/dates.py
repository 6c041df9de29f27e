"""Dates stored as YYYYMMDD integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType


def as_date(day: Column) -> Column:
    """YYYYMMDD integer to a date; null when it is none."""
    return F.to_date(F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")))


def as_int_day(value: Column, kind: DataType) -> Column:
    """Any of integer, date, timestamp or ISO text to a YYYYMMDD integer, 0 when unreadable."""
    if isinstance(kind, IntegralType):
        day = value.cast("int")
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        day = F.date_format(value, "yyyyMMdd").cast("int")
    else:
        text = F.trim(value.cast("string"))
        moment = F.coalesce(
            F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
            F.try_to_timestamp(text, F.lit("yyyyMMdd")),
            F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        )
        day = F.date_format(moment, "yyyyMMdd").cast("int")
    return F.coalesce(day, F.lit(0))


def iso_text(day: Column) -> Column:
    """20240115 to ``2024-01-15``."""
    digits = F.lpad(day.cast("string"), 8, "0")
    return F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))


def year_month(day: Column) -> Column:
    digits = F.lpad(day.cast("string"), 8, "0")
    return F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2))


def year_of(day: Column) -> Column:
    return F.floor(day / 10000).cast("int")
