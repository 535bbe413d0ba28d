"""Events: raw topic values to checked, typed rows and the two feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.decode import decode_events, with_event_time
from wardline.operators.quality import EVENT_RULES, expect
from wardline.schemas import INSIDER_TYPES, TXN


def bronze_events(
    raw: DataFrame, mode: str = "lenient", default_ts: Column | None = None, observe=None
) -> DataFrame:
    """Decoded events of the known types."""
    return expect(decode_events(raw, mode, default_ts=default_ts), EVENT_RULES, observe)


def silver_events(bronze: DataFrame) -> DataFrame:
    return with_event_time(bronze)


def features_fraud(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("type") == TXN).select("cardId", "amount", "event_time")


def features_insider(silver: DataFrame) -> DataFrame:
    return silver.where(F.col("type").isin(*INSIDER_TYPES)).select("actor", "type", "event_time")
