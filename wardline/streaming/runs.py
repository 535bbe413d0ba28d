"""Starting streams: triggers, checkpoints and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

SCORING_INTERVAL = "5 minutes"


def write_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = SCORING_INTERVAL,
    table_format: str = "parquet",
    partition_by: tuple[str, ...] = (),
    table: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append ``stream`` to the files at ``path`` (and the catalog ``table`` over them, if named).

    ``name`` shows in progress reports and errors. ``every`` is the micro-batch interval; ``None`` takes what is there now and stops. A restart with
    the same ``checkpoint`` goes on where the last run ended, without repeating rows.
    """
    writer = (
        stream.writeStream.format(table_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.toTable(table) if table else writer.start()


def drain(stream: DataFrame, path: str, checkpoint: str, **options) -> DataFrame:
    """Run ``stream`` over everything available now and return the written rows as a batch table."""
    query = write_stream(stream, path, checkpoint, every=None, **options)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
