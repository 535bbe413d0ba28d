"""Message topics as streams, and alerts back to a topic.

The Kafka connector is not part of Spark's own jars; a session that uses these functions needs the
``spark-sql-kafka`` package. :func:`topic_options` itself needs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.decode import encode_alerts

# Security protocol, mechanism and login line of the brokers.
SECURITY = {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN"}
LOGIN = (
    "org.apache.kafka.common.security.plain.PlainLoginModule required "
    'username="{user}" password="{password}";'
)
USER = "$ConnectionString"


def topic_options(brokers: str, password: str | None = None, user: str = USER) -> dict[str, str]:
    """Connection options; without a password the connection is plain."""
    options = {"kafka.bootstrap.servers": brokers}
    if password:
        options |= SECURITY
        options["kafka.sasl.jaas.config"] = LOGIN.format(user=user, password=password)
    return options


def source_options(
    brokers: str,
    *topics: str,
    password: str | None = None,
    group: str | None = None,
    starting: str = "earliest",
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of a topic source. Spark's own default start is the latest offset; ours is the earliest."""
    options = topic_options(brokers, password)
    options |= {"subscribe": ",".join(topics), "startingOffsets": starting}
    if group:
        options["kafka.group.id"] = group
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def read_topics(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """``value`` as text, with ``topic, partition, offset, timestamp`` and the arrival order ``seq``."""
    reader = spark.readStream if streaming else spark.read
    return topic_values(reader.format("kafka").options(**options).load())


def topic_values(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("value").cast("string").alias("value"),
        "topic", "partition", "offset", "timestamp",
        arrival_order(F.col("partition"), F.col("offset")).alias("seq"),
    )


def arrival_order(partition: Column, offset: Column) -> Column:
    """One number that orders like ``(offset, partition)``: a key lives in one partition of a topic,
    whose offsets are its arrival order. Room for 2^20 partitions, far beyond what a broker holds, and 2^43 offsets."""
    return offset * (1 << 20) + partition


def write_alerts(
    alerts: DataFrame, options: dict[str, str], topic: str, checkpoint: str, every: str = "5 seconds"
) -> StreamingQuery:
    """Send ``id, rule, ts`` as JSON."""
    return (
        encode_alerts(alerts)
        .writeStream.format("kafka")
        .options(**options)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(processingTime=every)
        .start()
    )


_LINE = T.StructType([T.StructField("value", T.StringType())])


def read_lines(
    spark: SparkSession, folder: str, streaming: bool = True, files_per_trigger: int = 1000
) -> DataFrame:
    """Topic values kept as text files, one per line, with their provenance (``_metadata``)."""
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.format("text").schema(_LINE).load(folder)
    return lines.select("value", "_metadata.*")
