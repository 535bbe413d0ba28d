"""What several operators need: the shared folder, cut lineage, checked broadcasts, word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import shared_root

# Words, everywhere in this package: runs of anything but space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

BROADCAST_ROWS = 100_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and written to the shared folder, so that lost executors cost no recomputation."""
    shared_root(frame.sparkSession)
    return frame.checkpoint()


def broadcast_checked(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table already written by :func:`cut`, if it has at most ``rows`` rows; beyond
    that the join shuffles both sides, and adaptive execution splits its skewed keys."""
    few = written.limit(rows + 1).count() <= rows
    return F.broadcast(written) if few else written


def tasks(spark: SparkSession) -> int:
    """Shuffle tasks the session is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def word_count(text: Column) -> Column:
    """Words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the text (null counts as empty), together the identity of a text."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)
