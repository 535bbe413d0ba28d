"""Left outer join on a key and a time band: ``|left − right| < band`` in whole seconds.

The time is part of the join key: each left row sits in its own bucket, right rows are copied to the
buckets whose band reaches them. A left row therefore meets each of its partners exactly once, outer
rows stay right without a second join, and a key's rows spread over as many tasks as it has buckets
(adaptive skew handling splits a bucket that is still too large).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.times import millis, own_bucket, visible_buckets

BAND = "1 hour"
BUCKET_BANDS = 4


def whole_seconds(at: Column) -> Column:
    """Seconds since the epoch, fractions cut off downwards."""
    return F.unix_timestamp(at)


def band_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    right_time: str,
    left_time: str = "event_time",
    band: str = BAND,
) -> DataFrame:
    """``left`` with the columns of ``right``, one row per pair in the band, NULLs where there is none.

    ``right_time`` must not be a column of ``left``. Works on two batch tables, on a stream and a
    batch table, and on two streams that both carry a watermark: there the band is repeated on the
    timestamps (one second wider, to allow for the cut fractions), which lets the join drop old state.
    """
    seconds = millis(band) // 1000
    width = seconds * BUCKET_BANDS
    at, other = whole_seconds(F.col(left_time)), whole_seconds(F.col(right_time))
    left = left.withColumn("_bucket", own_bucket(at, width))
    right = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull()).withColumn(
        "_seen_from", F.explode(visible_buckets(other, width, back=seconds, ahead=seconds))
    )
    condition = (
        (F.col(left_key) == F.col(right_key))
        & (F.col("_bucket") == F.col("_seen_from"))
        & (F.abs(at - other) < seconds)
    )
    if left.isStreaming and right.isStreaming:
        slack = F.expr(f"INTERVAL {seconds + 1} SECONDS")
        condition = condition & F.col(left_time).between(
            F.col(right_time) - slack, F.col(right_time) + slack
        )
    return left.join(right, condition, "left_outer").drop("_bucket", "_seen_from")
