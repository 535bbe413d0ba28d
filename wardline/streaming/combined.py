"""Joins of the alert stream with the feature streams, and the combined table on streams.

Stream-stream outer joins emit an unmatched row once the watermark shows that no partner can come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.times import iso_date, millis, visible_buckets
from wardline.operators.bandjoin import BAND, whole_seconds
from wardline.plans.gold import (
    DAY, alerts_with_activity, alerts_with_payments, entity_totals, threat_columns,
)
from wardline.streaming.threats import ACTIVITY, ALERT, DAY_SECONDS, DIMS, OUTPUT, PAYMENT, DayThreats


def watermarked(rows: DataFrame, delay: str, column: str = "event_time") -> DataFrame:
    """A watermark on streams; a batch table, as the static side of a join, passes unchanged."""
    return rows.withWatermark(column, delay) if rows.isStreaming else rows


def stream_alerts_with_payments(
    silver: DataFrame, fraud: DataFrame, delay: str, band: str = BAND
) -> DataFrame:
    """``gold.alerts_with_payments`` with ``silver`` a stream and ``fraud`` a stream or a table."""
    return alerts_with_payments(watermarked(silver, delay), watermarked(fraud, delay), band)


def stream_alerts_with_activity(
    silver: DataFrame, insider: DataFrame, delay: str, band: str = BAND
) -> DataFrame:
    """``gold.alerts_with_activity`` with ``silver`` a stream and ``insider`` a stream or a table."""
    return alerts_with_activity(watermarked(silver, delay), watermarked(insider, delay), band)


def join_by_batch(
    stream: DataFrame,
    side: Callable[[int, int], DataFrame],
    join: Callable[[DataFrame, DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    every: str | None = None,
    band: str = BAND,
) -> StreamingQuery:
    """Join every micro-batch with the part of a static table that it can reach, into files at ``path``.

    ``side`` gives that part for a period in epoch milliseconds: the batch's own, widened by ``band``, so that a
    table laid out by time is read and shuffled in part. A repeated batch overwrites its own files.
    """
    reach = millis(band)

    def one(batch: DataFrame, number: int) -> None:
        at = F.unix_millis("event_time")
        first, last = batch.agg(F.min(at), F.max(at)).first()
        near = side(0, 0).where("false") if first is None else side(first - reach, last + reach)
        join(batch, near).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


SLOTS = 64


def slot_of(key: str, slots: int, without: Column) -> Column:
    """The slot of a key, by hash; rows without a key are dealt by ``without``, since they meet no others."""
    return F.pmod(F.xxhash64(key, F.when(F.col(key).isNull(), without)), F.lit(slots))


def stream_combined_threat_analytics(
    silver: DataFrame, fraud: DataFrame, insider: DataFrame, delay: str = DAY, band: str = BAND, slots: int = SLOTS
) -> DataFrame:
    """``gold.combined_threat_analytics`` on streams; a day is emitted once the watermark has passed it and the band after it.

    Entities are dealt to ``slots`` by hash. The rows of a slot's day are held until then and worked out together
    (``streaming.threats``); payments and activities near midnight are copied to both days. So a slot's share of the open
    days must fit a task: take more slots for a larger stream. Their number is part of the state and stays with the checkpoint.
    Features that are tables are joined as such, which keeps no state of them.
    """
    if not (fraud.isStreaming and insider.isStreaming):
        return _combined_by_joins(silver, fraud, insider, delay, band)
    reach = millis(band) // 1000 - 1
    nothing = F.lit(None).cast("string")
    columns = {"name": nothing, **dict.fromkeys(DIMS, nothing), "amount": F.lit(None).cast("double")}

    def rows(frame: DataFrame, kind: int, key: str, **own: Column) -> DataFrame:
        at = whole_seconds(F.col("event_time"))
        # An alert stands in its own day only, a point in every day whose alerts it can reach.
        days = visible_buckets(at, DAY_SECONDS, *([0, 0] if kind == ALERT else [reach, reach]))
        return watermarked(frame.where(F.col("event_time").isNotNull()), delay).select(
            "event_time", F.lit(kind).alias("kind"), F.col(key).alias("id"), at.alias("at"), F.explode(days).alias("day"),
            *[value.alias(name) for name, value in (columns | own).items()],
        )

    paid = rows(fraud.where(F.col("cardId").isNotNull()), PAYMENT, "cardId", amount=F.col("amount"))
    acted = rows(insider.where(F.col("actor").isNotNull()), ACTIVITY, "actor", name=F.col("type"))
    alerts = rows(silver, ALERT, "id", name=F.col("rule"), **{name: F.col(name) for name in DIMS})
    parts = (
        alerts.union(paid).union(acted)
        .withColumns({"slot": slot_of("id", slots, F.col("at")), "has_amount": F.col("amount").isNotNull()})
        .groupBy("slot", "day")
        .transformWithStateInPandas(
            statefulProcessor=DayThreats(reach), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
            eventTimeColumnName="event_time",
        )
    )
    # A sum of amounts that is not a number comes back as null.
    total = F.when(F.col("amounts") > 0, F.coalesce("paid", F.lit(float("nan"))))
    grouped = parts.groupBy("event_time", "day", *DIMS).agg(
        F.sum(total).alias("paid"),
        *[F.sum(name).alias(name) for name in ("alert_count", "amounts", "cards_involved", "actors_involved")],
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name) for name in ("rules", "types")],
    )
    return threat_columns(grouped.withColumn("date", iso_date(F.timestamp_seconds(F.col("day") * DAY_SECONDS))))


def _combined_by_joins(silver: DataFrame, fraud: DataFrame, insider: DataFrame, delay: str, band: str) -> DataFrame:
    """The same where a side is a table.

    Payments are summed up per alert second before activities are joined, so an alert meets its
    payments and then its activities instead of every combination of the two. All figures add up over
    joined rows, hence the counts are those of the full join.
    """
    dims = ["alert_type", "severity"]
    alerts = silver.select("id", *dims, "rule", "event_time")
    paid = (
        stream_alerts_with_payments(alerts, fraud, delay, band)
        .groupBy(F.window("event_time", "1 second").alias("second"), "id", *dims, "rule")
        .agg(
            F.count("*").alias("rows"),
            F.sum("amount").alias("paid"),
            F.count("amount").alias("amounts"),
            F.max(F.col("cardId").isNotNull().cast("int")).alias("has_payment"),
        )
        .withColumn("event_time", F.window_time("second"))
        .drop("second")
    )
    joined = alerts_with_activity(paid, watermarked(insider, delay), band)
    measures = {
        "alert_count": (F.sum("rows"), F.sum),
        "paid": (F.sum("paid"), F.sum),
        "amounts": (F.sum("amounts"), F.sum),
        "cards_involved": (F.max("has_payment"), F.sum),
        "actors_involved": (F.max(F.col("actor").isNotNull().cast("int")), F.sum),
    }
    days = joined.withColumn("window", F.window("event_time", DAY))
    grouped = entity_totals(days, ["window", *dims], measures, ("rule", "type"))
    return threat_columns(grouped.withColumn("date", iso_date(F.col("window.start"))))
