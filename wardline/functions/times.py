"""Time helpers. The session zone is UTC (see ``session.RUNTIME_CONF``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(duration: str) -> int:
    """``'30 minutes'`` -> 1800000."""
    number, unit = re.fullmatch(r"(\d+) (\w+?)s?", duration.strip()).groups()
    return int(number) * _UNIT_MS[unit]


def from_millis(ts: Column) -> Column:
    return F.timestamp_millis(ts)


def iso_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def visible_buckets(at: Column, width: int, back: int = 0, ahead: int = 0) -> Column:
    """Buckets ``b`` of ``width`` that look ``back`` before their start and ``ahead`` past their end
    and can therefore see a row at ``at`` (whole numbers in one unit).

    Exploding it copies a row once per bucket that sees it: ``1 + (back + ahead) / width`` copies on
    average, independent of how many rows a key has.
    """
    lowest = F.floor((at - F.lit(ahead)) / F.lit(width)).cast("long")
    highest = F.floor((at + F.lit(back)) / F.lit(width)).cast("long")
    return F.sequence(lowest, highest)


def own_bucket(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")
