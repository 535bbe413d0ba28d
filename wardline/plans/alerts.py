"""Alerts: raw topic values to checked rows, and their business reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import ladders
from wardline.operators.decode import decode_alerts, with_event_time
from wardline.operators.quality import ALERT_RULES, expect


def bronze_alerts(raw: DataFrame, ingestion_ts: Column | None = None, observe=None) -> DataFrame:
    """Decoded alerts with whatever provenance columns ``raw`` brings (see ``sources.topics``)."""
    stamp = F.current_timestamp() if ingestion_ts is None else ingestion_ts
    return with_event_time(
        expect(decode_alerts(raw), ALERT_RULES, observe).withColumn("ingestion_ts", stamp)
    )


def silver_alerts(bronze: DataFrame) -> DataFrame:
    """Type, severity, category, impact and date parts of each alert."""
    rule, at = F.col("rule"), F.col("event_time")
    severity = ladders.by_substring(rule, ladders.SEVERITY, "MEDIUM")
    return bronze.withColumns({
        "alert_type": ladders.by_substring(rule, ladders.ALERT_TYPE, "UNKNOWN"),
        "severity": severity,
        "alert_category": ladders.by_substring(rule, ladders.ALERT_CATEGORY, "Security Event"),
        "business_impact": ladders.by_value(severity, ladders.BUSINESS_IMPACT, "Low - Monitor"),
        "year": F.year(at),
        "month": F.month(at),
        "day": F.dayofmonth(at),
        "hour": F.hour(at),
    })
