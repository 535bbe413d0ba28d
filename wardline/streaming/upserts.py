"""Streams in update mode into a table that holds the latest row of each key.

Each micro-batch writes the rows that changed to a folder of its own, named by the batch's number. A batch that runs again, after a
failure, overwrites that folder with the same rows, so nothing counts twice. Reading takes the row of the highest
batch per key. :func:`snapshot` folds what there is into one folder, so that reads need only later changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def write_changes(rows: DataFrame, batch: int, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Keep the table at ``path`` up to date with an aggregate ``rows`` in update mode; ``every=None`` takes what is there and stops."""
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.foreachBatch(lambda batch, number: write_changes(batch, number, path)).start()


def folder_numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers in the names of the folders under ``path`` that are wholly written."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found or [])


def written(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all whole batches, for streams whose rows never change; none before the first."""
    folders = [f"{path}/changes/batch={n}" for n in folder_numbers(spark, path, "changes/batch")]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    """The latest row of each key."""
    folded = folder_numbers(spark, path, "snapshots/upto")[-1:]
    later = [n for n in folder_numbers(spark, path, "changes/batch") if not folded or n > folded[0]]
    sources = [(folded[0], f"{path}/snapshots/upto={folded[0]}")] if folded else []
    sources += [(n, f"{path}/changes/batch={n}") for n in later]
    if not sources:
        return spark.createDataFrame([], schema)
    # One scan over all folders; a file's folder tells its batch.
    rows = spark.read.schema(schema).parquet(*[folder for _, folder in sources])
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:batch|upto)=(\d+)/", 1).cast("long")
    held = rows.select(F.struct(*schema.names).alias("row"), batch.alias("batch"))
    groups = held.groupBy(*[F.col(f"row.{key}").alias(f"key_{i}") for i, key in enumerate(keys)])
    return groups.agg(F.max_by("row", "batch").alias("row")).select("row.*")


def snapshot(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> None:
    """Fold all changes so far into one folder. Readers go on with the one before until it is whole."""
    batches = folder_numbers(spark, path, "changes/batch")
    if batches and batches[-1:] != folder_numbers(spark, path, "snapshots/upto")[-1:]:
        current(spark, path, keys, schema).write.mode("overwrite").parquet(f"{path}/snapshots/upto={batches[-1]}")
