"""Compaction of tables that running streams append to.

A stream appends many small files in order of arrival. :func:`compact` gathers the small ones into files of about ``target``
bytes, ordered by the interleaved bits of several columns, so that the statistics of the files let a scan skip on any
of them. Files that are large already stay as they are, whoever wrote them. What readers must take is a manifest, a table of file names
that is written whole under a new version; writing it is the swap. :func:`read` takes the files of the
latest whole manifest and those that the stream has added since.

Nothing is moved or deleted: the stream, its readers and queries that began before the swap go on over the files they know. A
compaction that dies before the swap leaves the version before valid, and the next one overwrites its files. Run one
compaction of a table at a time. The names and sizes of files go through the driver, where Spark lists them for any
read; rows never do.

Defined results: rows and columns are those of the table, in no order; a table of fewer than two small files stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType, TimestampType

from wardline.streaming.upserts import folder_numbers

TARGET = 256 << 20
BITS = 8
_MANIFEST = "path string, length long, taken boolean"


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of a table's files; of a stream's table only those of finished batches."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def manifest(spark: SparkSession, store: str) -> tuple[int, DataFrame]:
    """The latest whole version (0 before the first) and its files; ``taken`` ones have their rows in another."""
    versions = folder_numbers(spark, store, "manifest/version")
    if not versions:
        return 0, spark.createDataFrame([], _MANIFEST)
    return versions[-1], spark.read.schema(_MANIFEST).parquet(f"{store}/manifest/version={versions[-1]}")


def _current(spark: SparkSession, path: str, store: str) -> tuple[int, DataFrame, DataFrame]:
    """The version, its files, and the files that hold the table's rows now."""
    version, known = manifest(spark, store)
    added = files(spark, path).join(known.select("path"), "path", "left_anti")
    return version, known, known.where("NOT taken").select("path", "length").union(added)


def read(spark: SparkSession, path: str, store: str, schema: StructType) -> DataFrame:
    """All rows of the table, from compacted files as far as there are any."""
    names = [row["path"] for row in _current(spark, path, store)[2].collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def _number(rows: DataFrame, column: str) -> Column:
    """A double that orders like ``column``; texts by their first six bytes."""
    kind = rows.schema[column].dataType
    if isinstance(kind, StringType):
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return (F.unix_micros(column) if isinstance(kind, TimestampType) else F.col(column)).cast("double")


def interleaved(rows: DataFrame, columns: list[str], name: str = "_z") -> DataFrame:
    """``rows`` with a number whose bits are, in turns, those of each column's rank among its quantiles."""
    numbers = [f"_number{i}" for i in range(len(columns))]
    ranked = rows.withColumns({number: _number(rows, column) for number, column in zip(numbers, columns)})
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    for number, cuts in zip(numbers, ranked.approxQuantile(numbers, steps, 0.002)):
        splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
        # Rows without a value come last.
        ranked = Bucketizer(splits=splits, inputCol=number, outputCol=f"{number}_rank", handleInvalid="keep").transform(ranked)
    bits = [
        F.shiftleft(F.shiftright(F.col(f"{number}_rank").cast("long"), bit).bitwiseAND(F.lit(1)), bit * len(columns) + i)
        for bit in range(BITS + 1) for i, number in enumerate(numbers)
    ]
    return ranked.withColumn(name, reduce(Column.__add__, bits)).drop(*numbers, *[f"{number}_rank" for number in numbers])


def compact(
    spark: SparkSession, path: str, store: str, schema: StructType, columns: list[str], target: int = TARGET
) -> int:
    """Gather the files below half of ``target`` bytes, ordered by ``columns``, and return the version that holds."""
    version, known, current = _current(spark, path, store)
    small = current.where(F.col("length") < target // 2).collect()
    if len(small) < 2:
        return version
    names = [row["path"] for row in small]
    number = max(1, -(-sum(row["length"] for row in small) // target))
    rows = interleaved(spark.read.schema(schema).parquet(*names), columns)
    into = f"{store}/data/version={version + 1}"
    rows.repartitionByRange(number, "_z", *columns).sortWithinPartitions("_z", *columns).drop("_z") \
        .write.mode("overwrite").parquet(into)
    gathered = spark.createDataFrame([(name,) for name in names], "path string")
    kept = current.join(gathered, "path", "left_anti").select("*", F.lit(False).alias("taken"))
    taken = known.where("taken").union(current.join(gathered, "path", "left_semi").select("*", F.lit(True).alias("taken")))
    made = files(spark, into).select("*", F.lit(False).alias("taken"))
    # Fails if another compaction has written this version.
    kept.union(taken).union(made).write.parquet(f"{store}/manifest/version={version + 1}")
    return version + 1
