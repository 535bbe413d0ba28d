"""Scoring a stream by models that may be replaced while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.model_versions import score_by_version, versions
from wardline.operators.scoring import decide
from wardline.streaming.upserts import write_changes


def score_stream_by_version(payments: DataFrame, models: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Score ``payments`` into the table at ``path``; ``every=None`` takes what is there and stops.

    The versions at ``models`` are read anew in each micro-batch, so a version published meanwhile holds from the next one
    on, without a restart. A batch that runs again overwrites its own folder under ``path/changes``.
    """

    def run(batch: DataFrame, number: int) -> None:
        write_changes(decide(score_by_version(batch, versions(batch.sparkSession, models))), number, path)

    writer = payments.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.foreachBatch(run).start()
