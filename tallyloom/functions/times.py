"""Instants and days in UTC, whatever time zone the session has."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(ts: Column | str) -> Column:
    """The timestamp whose fields, read in the session's zone, are those of `ts` in UTC."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def instant(text: str) -> Column:
    """`YYYY-MM-DD` or `YYYY-MM-DD HH:MM:SS` in UTC."""
    return F.lit(f"{text if ' ' in text else text + ' 00:00:00'}+00:00").cast("timestamp")
