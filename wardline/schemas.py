"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("cardId", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("actor", T.StringType()),
    T.StructField("ts", T.LongType()),
])

ALERT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("ts", T.LongType()),
])

# The event vocabulary and the rule names.
TXN = "TXN"
INSIDER_TYPES = ("PRIV_ESC", "BULK_EXPORT", "EXT_SHARE")
EVENT_TYPES = (TXN, *INSIDER_TYPES)
SMALL_THEN_LARGE = "SMALL_THEN_LARGE"
INSIDER_EXFIL = "INSIDER_EXFIL"
