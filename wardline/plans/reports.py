"""Report queries over the gold tables.

``as_of`` (a Column, a datetime or ISO text) stands for "now", so that a report over the same table
repeats. Filters are on plain columns, so on tables laid out by date they prune files.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = Column | datetime | str

WEEK, MONTH = 7, 30


def _time(as_of: Moment) -> Column:
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")


def _since(date: str, as_of: Moment, days: int) -> Column:
    """The date text lies at most ``days`` days before ``as_of`` (ISO dates order as text)."""
    first = F.date_sub(F.to_date(_time(as_of)), days)
    return F.col(date) >= F.date_format(first, "yyyy-MM-dd")


def dashboard_last_hour(dashboard: DataFrame, as_of: Moment) -> DataFrame:
    return (
        dashboard.where(F.col("window_start") >= _time(as_of) - F.expr("INTERVAL 1 HOUR"))
        .select("window_start", "alert_type", "severity", "alert_count", "risk_score")
        .orderBy(F.desc("window_start"))
    )


def daily_summary_week(daily: DataFrame, as_of: Moment) -> DataFrame:
    return (
        daily.where(_since("date", as_of, WEEK))
        .select("date", "alert_type", "total_alerts", "severity", "weighted_risk_score")
        .orderBy(F.desc("date"), F.desc("weighted_risk_score"))
    )


def spikes(patterns: DataFrame) -> DataFrame:
    return (
        patterns.where("is_spike")
        .select("pattern_date", "rule", "pattern_count", "pattern_intensity", "is_spike")
        .orderBy(F.desc("pattern_count"))
    )


def executive_month(executive: DataFrame, as_of: Moment) -> DataFrame:
    return (
        executive.where(_since("date", as_of, MONTH))
        .select("date", "total_alerts", "critical_percentage", "risk_index", "threat_trend")
        .orderBy(F.desc("date"))
    )


def current_hour(dashboard: DataFrame, as_of: Moment) -> DataFrame:
    grouped = (
        dashboard.where(F.col("window_start") >= F.date_trunc("HOUR", _time(as_of)))
        .groupBy("window_start", "alert_type", "severity")
        .agg(F.sum("alert_count").alias("total_alerts"), F.avg("risk_score").alias("avg_risk_score"))
        .orderBy(F.desc("window_start"))
    )
    shown = F.date_format("window_start", "HH:mm").alias("time_window")
    return grouped.select(shown, "alert_type", "severity", "total_alerts", "avg_risk_score")


def risk_trend_week(executive: DataFrame, as_of: Moment) -> DataFrame:
    rounded = {
        "critical_pct": "critical_percentage", "fraud_pct": "fraud_percentage",
        "insider_pct": "insider_percentage", "risk_index": "risk_index",
    }
    return (
        executive.where(_since("date", as_of, WEEK))
        .select(
            "date", "total_alerts",
            *[F.round(source, 2).alias(name) for name, source in rounded.items()],
            "threat_trend",
        )
        .orderBy(F.desc("date"))
    )


def top_patterns_week(patterns: DataFrame, as_of: Moment) -> DataFrame:
    return (
        patterns.where(
            _since("pattern_date", as_of, WEEK)
            & F.col("pattern_intensity").isin("HIGH_SPIKE", "MODERATE_SPIKE")
        )
        .groupBy("rule")
        .agg(
            F.count("*").alias("occurrences"),
            F.countDistinct("pattern_date").alias("active_days"),
            F.avg("pattern_count").alias("avg_daily_alerts"),
            F.max("pattern_count").alias("peak_alerts"),
        )
        .orderBy(F.desc("occurrences"))
    )


def fraud_vs_insider_month(combined: DataFrame, as_of: Moment) -> DataFrame:
    return (
        combined.where(_since("date", as_of, MONTH))
        .groupBy("date", "alert_type", "threat_level")
        .agg(
            F.sum("alert_count").alias("alerts"),
            F.sum("cards_involved").alias("cards_affected"),
            F.sum("actors_involved").alias("actors_involved"),
            F.round(F.sum("total_amount_affected"), 2).alias("total_amount"),
        )
        .orderBy(F.desc("date"), F.desc("alerts"))
    )
