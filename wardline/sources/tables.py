"""Tables: reading them as streams or as they are, and writing them so that scans can skip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_increments(spark: SparkSession, table: str) -> DataFrame:
    """The rows a table gains, as a stream."""
    return spark.readStream.table(table)


def stream_or_static(spark: SparkSession, table: str, fallback: str) -> DataFrame:
    """The stream of ``table`` if it exists, else ``fallback`` as it stands now."""
    if spark.catalog.tableExists(table):
        return read_increments(spark, table)
    return spark.table(fallback)


def lay_out(rows: DataFrame, cluster_by: str, *ties: str, partition_by: str | None = None, files: int | None = None) -> DataFrame:
    """Rows of neighbouring ``cluster_by`` values side by side, so that the min/max statistics of the
    files let a scan skip most of them. ``ties`` order rows of equal value, which also lets a value
    that holds many rows spread over several files."""
    keys = [*([partition_by] if partition_by else []), cluster_by, *ties]
    spread = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def write_table(
    rows: DataFrame,
    path: str,
    cluster_by: str,
    *ties: str,
    partition_by: str | None = None,
    files: int | None = None,
    table: str | None = None,
    mode: str = "overwrite",
    table_format: str = "parquet",
) -> DataFrame:
    """Write ``rows`` laid out by ``cluster_by`` and return the written table."""
    writer = lay_out(rows, cluster_by, *ties, partition_by=partition_by, files=files)
    writer = writer.write.mode(mode).format(table_format)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if table:
        writer.option("path", path).saveAsTable(table)
        return rows.sparkSession.table(table)
    writer.save(path)
    return rows.sparkSession.read.format(table_format).schema(rows.schema).load(path)
