"""The ``events`` test table seen as the two event topics and as an alert feed.

One fixed mapping from its event types to ours; ``error`` has no counterpart and stays unmapped.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.ladders import by_value
from wardline.schemas import INSIDER_TYPES, TXN

# Source event type -> event type, and -> rule of the alert feed.
TYPE_OF = [
    ("purchase", "TXN"), ("signup", "PRIV_ESC"), ("view", "BULK_EXPORT"), ("click", "EXT_SHARE"),
]
RULE_OF = [
    ("purchase", "SMALL_THEN_LARGE"), ("click", "INSIDER_EXFIL"), ("error", "FRAUD_OTHER"),
]


def read_table(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(
    spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 1000
) -> DataFrame:
    """The same files as a stream. The braces make the path a pattern, as a stream needs for a table
    that is one file; a folder of files matches too."""
    schema = read_table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/{{{name}}}.parquet")
    )


# Flush rows: distance from the last event and from each other, and how many.
FLUSH_EVERY_DAYS, FLUSHES = 100, 3


def flush_user(source: DataFrame) -> int:
    """A user that ``source`` doesn't have: one below its least, and below 0."""
    return min(0, source.agg(F.min("user_id").alias("least")).first()["least"] or 0) - 1


def replay(spark: SparkSession, folder: str, path: str, slices: int = 3) -> DataFrame:
    """The table as a stream that ends with all of its results: written to ``path`` as one file per time slice,
    then files of one event of each type far in the future, and read file by file. A stream emits what its
    watermark has passed, so the last rows need later ones; these belong to :func:`flush_user` and lie
    ``FLUSH_EVERY_DAYS`` after the table's last event. An empty table, or one without times, has no slices and no
    flush rows: it is one file."""
    table = read_table(spark, folder)
    first, last = table.agg(F.min("ts"), F.max("ts")).first()
    if last is None:
        table.coalesce(1).write.parquet(path)
        return spark.readStream.schema(table.schema).parquet(path)
    step = (last - first) / slices
    for number in range(slices):
        from_here = F.col("ts").isNull() if number == 0 else F.lit(False)  # events without a time go first
        to_there = F.lit(True) if number == slices - 1 else F.col("ts") < _moment(first + (number + 1) * step)
        part = table.where(from_here | ((F.col("ts") >= _moment(first + number * step)) & to_there))
        part.coalesce(1).write.mode("append").parquet(path)
    kinds, user = [name for name, _ in [*TYPE_OF, ("error", None)]], flush_user(table)
    for number in range(1, FLUSHES + 1):
        at = last + timedelta(days=FLUSH_EVERY_DAYS * number)
        rows = [(-number * 10 - i, at, user, kind, 0.0, None) for i, kind in enumerate(kinds)]
        spark.createDataFrame(rows, table.select("event_id", "ts", "user_id", "event_type", "value", "props").schema
                              ).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def without_flush(results: DataFrame, source: DataFrame) -> DataFrame:
    """``results`` of a replay of ``source`` without those of the flush rows, told by entity or else by time."""
    for name in ("id", "entity", "cardId"):
        if name in results.columns:
            return results.where(F.col(name).isNull() | (F.col(name) != str(flush_user(source))))
    end = source.agg(F.max("ts").alias("end")).first()["end"]
    if end is None:
        return results
    end += timedelta(days=FLUSH_EVERY_DAYS // 2)
    if "window_start" in results.columns:
        return results.where(F.col("window_start") < F.lit(str(end)).cast("timestamp"))
    return results.where(F.col("date").isNull() | (F.col("date") < end.strftime("%Y-%m-%d")))


def _moment(at: object) -> Column:
    return F.lit(str(at)).cast("timestamp_ntz")


def since(source: DataFrame, moment: str) -> DataFrame:
    """Events from ``moment`` (ISO text) on, as a filter the scan can use."""
    return source.where(F.col("ts") >= _moment(moment))


def between(source: DataFrame, first_ms: int, last_ms: int) -> DataFrame:
    """Events of a period (epoch milliseconds, both ends included), as a filter the scan can use."""
    first, last = (datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None) for ms in (first_ms, last_ms))
    return source.where((F.col("ts") >= _moment(first)) & (F.col("ts") <= _moment(last)))


def _event_time() -> Column:
    return F.col("ts").cast("timestamp")


def domain_events(source: DataFrame) -> DataFrame:
    """``type, cardId, amount, actor, ts`` plus the arrival order ``seq`` and ``event_time``.

    Payments carry a card and an amount, the other types an actor.
    """
    kind = by_value(F.col("event_type"), TYPE_OF, "ERROR")
    who = F.col("user_id").cast("string")
    is_txn = F.col("type") == TXN
    return source.select(
        kind.alias("type"),
        who.alias("who"),
        F.col("value"),
        F.unix_millis(_event_time()).alias("ts"),
        F.col("event_id").alias("seq"),
    ).select(
        "type",
        F.when(is_txn, F.col("who")).alias("cardId"),
        F.when(is_txn, F.col("value")).alias("amount"),
        F.when(~is_txn, F.col("who")).alias("actor"),
        "ts",
        "seq",
        F.timestamp_millis("ts").alias("event_time"),
    )


def auth_txn(source: DataFrame) -> DataFrame:
    """The payment topic."""
    return domain_events(source.where(F.col("event_type") == "purchase"))


def insider_events(source: DataFrame) -> DataFrame:
    """The insider topic."""
    kinds = [name for name, kind in TYPE_OF if kind in INSIDER_TYPES]
    return domain_events(source.where(F.col("event_type").isin(*kinds)))


def all_activity(source: DataFrame) -> DataFrame:
    """Every event under one key, so that types a rule does not name come in between."""
    return domain_events(source).withColumns({
        "cardId": F.coalesce("cardId", "actor"),
        "actor": F.coalesce("actor", "cardId"),
    })


def alert_feed(source: DataFrame) -> DataFrame:
    """``id, rule, ts``: one alert per purchase, click and error."""
    kinds = [name for name, _ in RULE_OF]
    return source.where(F.col("event_type").isin(*kinds)).select(
        F.col("user_id").cast("string").alias("id"),
        by_value(F.col("event_type"), RULE_OF, None).alias("rule"),
        F.unix_millis(_event_time()).alias("ts"),
    )


def alert_feed_with_gaps(source: DataFrame) -> DataFrame:
    """Every event as an alert: those of other types have no rule, and sign-ups no id either."""
    return source.select(
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("id"),
        by_value(F.col("event_type"), RULE_OF, None).alias("rule"),
        F.unix_millis(_event_time()).alias("ts"),
    )


def as_json(source: DataFrame) -> DataFrame:
    """Raw topic values in every shape the decoders tell apart, one shape per event type:
    a plain payment, a number as text, a fractional ``ts``, missing fields, broken JSON."""
    who = F.col("user_id").cast("string")
    millis = F.unix_millis(_event_time())
    shapes = [
        ("purchase", F.to_json(F.struct(
            F.lit("TXN").alias("type"), who.alias("cardId"), F.col("value").alias("amount"),
            millis.alias("ts")))),
        ("click", F.to_json(F.struct(
            F.lit("EXT_SHARE").alias("type"), F.col("user_id").alias("actor"),
            F.col("value").cast("string").alias("amount"), millis.cast("string").alias("ts")))),
        ("view", F.to_json(F.struct(
            F.lit("BULK_EXPORT").alias("type"), who.alias("actor"),
            (millis.cast("decimal(20,1)") + F.lit(0.5).cast("decimal(2,1)")).alias("ts")))),
        ("signup", F.to_json(F.struct(F.lit("PRIV_ESC").alias("type")))),
    ]
    broken = F.concat(F.lit('{"type":"TXN","cardId":"'), who)
    value = broken
    for name, shape in shapes:
        value = F.when(F.col("event_type") == name, shape).otherwise(value)
    return source.select(F.col("event_id").alias("seq"), value.alias("value"))
