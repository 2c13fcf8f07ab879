"""Time text and parts.  The session's time zone is taken to be UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bound of a first load.
FIRST_LOAD = "1800-01-01 00:00:00"


def time_parts(ts: Column | str) -> dict[str, Column]:
    """Year, month, day, hour and minute as zero-padded strings."""
    formats = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH", "minute": "mm"}
    return {k: F.date_format(ts, v) for k, v in formats.items()}


def millis_to_text(ms: Column | str) -> Column:
    """yyyy-MM-dd HH:mm:ss of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def text_to_millis(text: Column | str) -> Column:
    """Epoch milliseconds of yyyy-MM-dd HH:mm:ss; null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def partition_of(run_date: dt.date) -> str:
    """The partition that a run loads: the day before, as yyyyMMdd."""
    return f"{run_date - dt.timedelta(days=1):%Y%m%d}"
