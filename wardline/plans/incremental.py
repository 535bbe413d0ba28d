"""Gold tables by date, kept up to date day by day.

Alerts, payments and activity arrive in batches. They are kept by date and batch; each gold table is partitioned by date, and
a batch rebuilds, from what is kept, only the days that its rows can change: their own, the one before where a window reaches
over midnight, and for the combined table the days within a band of its payments and activity. Only these days'
partitions are read and overwritten. A batch that is repeated overwrites its own rows and rebuilds the same days, so
nothing counts twice; it must hold the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.times import iso_date, millis
from wardline.operators.bandjoin import BAND
from wardline.plans import gold

Day = str | None  # an ISO date; None for rows without a time

INPUTS = ("silver_alerts", "features_fraud", "features_insider")
TABLES = {
    "gold_alert_dashboard": gold.alert_dashboard,
    "gold_daily_alert_summary": gold.daily_alert_summary,
    "gold_alert_patterns": gold.alert_patterns,
    "gold_alert_pattern_entities": gold.pattern_entities,
    "gold_executive_dashboard": gold.executive_dashboard,
    "gold_combined_threat_analytics": None,
}
_SLIDING = ("gold_alert_patterns", "gold_alert_pattern_entities")


def _shifted(seconds: int) -> Column:
    return iso_date(F.timestamp_seconds(F.unix_timestamp("event_time") + F.lit(seconds)))


def touched(rows: DataFrame, *shifts: int) -> set[Day]:
    """The days of the rows' times, moved by each of ``shifts`` seconds."""
    found = rows.select(F.explode(F.array(*[_shifted(by) for by in shifts])).alias("day")).distinct().collect()
    return {row["day"] for row in found}


def _around(days: Iterable[Day], back: int, ahead: int) -> set[Day]:
    """The days and their neighbours."""
    return {None if day is None else (date.fromisoformat(day) + timedelta(by)).isoformat() for day in days for by in range(-back, ahead + 1)}


def _within(column: str, days: Iterable[Day]) -> Column:
    known = sorted(day for day in days if day is not None)
    found = F.col(column).isin(known) if known else F.lit(False)
    return found | F.col(column).isNull() if None in days else found


@dataclass(frozen=True)
class DailyGold:
    """The kept rows and the gold tables under ``root``."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        """Overwrite the partitions that ``rows`` has. The shape is kept apart, since a table of no rows has no file."""
        rows.limit(0).write.mode("ignore").parquet(f"{self.root}/shapes/{name}")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(name))

    def _rows(self, spark: SparkSession, name: str) -> DataFrame:
        shape = spark.read.parquet(f"{self.root}/shapes/{name}").schema
        return spark.read.schema(shape).parquet(self.path(name))

    def _kept(self, spark: SparkSession, name: str, days: set[Day]) -> DataFrame:
        return self._rows(spark, name).where(_within("kept_date", days)).drop("kept_date", "kept_batch")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A gold table, with its columns as in ``plans.gold``."""
        return self._rows(spark, name).drop("day")

    def add(self, batch: str, alerts: DataFrame, fraud: DataFrame, insider: DataFrame, tables: Iterable[str] = tuple(TABLES)) -> dict[str, set[Day]]:
        """Take in one batch and return the days that were rebuilt in each table."""
        spark, band = alerts.sparkSession, millis(BAND) // 1000
        for name, rows in zip(INPUTS, (alerts, fraud, insider)):
            kept = rows.withColumns({"kept_date": iso_date(F.col("event_time")), "kept_batch": F.lit(batch)})
            self._write(kept, name, "kept_date", "kept_batch")
        own = touched(alerts, 0)
        rebuilt = {}
        for name in tables:
            days, reach = set(own), 0
            if name in _SLIDING:
                days, reach = touched(alerts.where("event_time IS NOT NULL"), 0, -millis(gold.PATTERN_SLIDE) // 1000), 1
            elif name == "gold_alert_dashboard":
                days -= {None}
            elif name == "gold_combined_threat_analytics":
                days |= touched(fraud, -band, band) | touched(insider, -band, band)
            self._rebuild(spark, name, days, reach)
            rebuilt[name] = days
        return rebuilt

    def _rebuild(self, spark: SparkSession, name: str, days: set[Day], reach: int) -> None:
        silver = self._kept(spark, "silver_alerts", _around(days, 0, reach))
        if TABLES[name]:
            rows = TABLES[name](silver)
        else:
            near = [self._kept(spark, other, _around(days, 1, 1)) for other in INPUTS[1:]]
            rows = gold.combined_threat_analytics(silver, *near)
        if "date" in rows.columns:
            self._write(rows.where(_within("date", days)), name, "date")
        else:
            day = iso_date(F.col("window_start"))
            self._write(rows.withColumn("day", day).where(_within("day", days)), name, "day")
