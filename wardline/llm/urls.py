"""URL filters as a temporal list join, in DataFrame functions alone.

Lists are logs of dated entries: a pattern (a host, or a domain that covers all hosts below it) is listed with an
action, listed anew, or removed. Every entry becomes a validity interval that ends where the next entry of its list
and pattern begins. A capture is evaluated against the entries active on the day it was fetched; the most specific
pattern wins, then blocking over allowing.

Captures are reduced to their distinct (host, day) pairs, map-side first, before anything else, so a host that has a
third of all captures costs as many rows as there are days. Intervals and days meet on (pattern, time bucket), which
bounds what a pattern of long history or many hosts brings together. The verdicts, one row per pair, are written and
joined to the captures, where adaptive execution splits a pair that is still large.

A host of any length is looked up by the domains above it, of as many labels as the longest pattern has.

Defined results: a null, empty or hostless URL, one without a scheme (nothing marks its host), or a null day gets the
verdict ``none``; repeated captures get a row each; entries without list, pattern or date are
no entries; of entries equal in list, pattern and date the one that removes, then the blocking one, holds; empty tables
give no rows or no matches; columns other than those named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.shared import cut

BUCKET_DAYS = 32

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)"
_ADDRESS = r"^(\[.*|[0-9.]+)$"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port and closing dots; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), _HOST, 1), r"\.+$", "")
    return F.when(F.length(found) > 0, found)


def covering(host: Column, most: int | None = None) -> Column:
    """The host and the domains above it, or those of at most ``most`` labels, as an array; an address has none above it."""
    labels = F.split(host, "[.]")
    first = F.lit(1) if most is None else F.greatest(F.lit(1), F.size(labels) - F.lit(most - 1))
    above = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(above)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, action, since, until`` (a null ``until``: still valid) from the log
    ``list, pattern, action, day``, whose action may be ``remove``."""
    log = entries.select("list", F.lower("pattern").alias("pattern"), "action", "day").where(
        "list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL")
    rank = F.when(F.col("action") == "remove", 0).when(F.col("action") == "block", 1).otherwise(2)
    one = log.groupBy("list", "pattern", "day").agg(F.min(F.struct(rank.alias("rank"), "action")).alias("first"))
    following = Window.partitionBy("list", "pattern").orderBy("day")
    return (
        one.select("list", "pattern", F.col("first.action").alias("action"), F.col("day").alias("since"),
                   F.lead("day").over(following).alias("until"))
        .where("action <> 'remove'")
    )


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(BUCKET_DAYS)).cast("int")


def evaluate(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url",
             fetched: str = "fetched") -> DataFrame:
    """Per capture ``capture_id, host, fetched, verdict, list, pattern, since``."""
    named = captures.select(F.col(capture_id).alias("capture_id"), host_of(F.col(url)).alias("host"),
                            F.col(fetched).cast("date").alias("fetched"))
    asked = cut(named.select("host", "fetched").where("host IS NOT NULL AND fetched IS NOT NULL").distinct())
    days = asked.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last")).first()
    valid = cut(intervals(entries))
    most = valid.agg(F.max(F.size(F.split("pattern", "[.]"))).alias("labels")).first()["labels"] or 1
    over = valid.where((F.col("since") <= F.lit(days["last"])) & (F.col("until").isNull() | (F.col("until") > F.lit(days["first"]))))
    spread = over.withColumn("bucket", F.explode(F.sequence(
        _bucket(F.greatest(F.col("since"), F.lit(days["first"]))),
        _bucket(F.least(F.coalesce(F.date_sub("until", 1), F.lit(days["last"])), F.lit(days["last"]))))))
    patterns = asked.select("host", "fetched", _bucket(F.col("fetched")).alias("bucket"),
                            F.posexplode(covering(F.col("host"), most)).alias("depth", "covering"))
    matched = patterns.join(spread, (F.col("covering") == F.col("pattern")) & (patterns["bucket"] == spread["bucket"])
                            & (F.col("since") <= F.col("fetched"))
                            & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    first = F.struct("depth", F.when(F.col("action") == "block", 0).otherwise(1).alias("rank"), "list", "action", "pattern", "since")
    verdicts = cut(
        matched.groupBy("host", "fetched").agg(F.min(first).alias("best"))
        .select(F.col("host").alias("of"), F.col("fetched").alias("at"), "best")
    )
    return named.join(verdicts, (F.col("host") == F.col("of")) & (F.col("fetched") == F.col("at")), "left").select(
        F.col("capture_id").alias(capture_id), "host", F.col("fetched").alias(fetched),
        F.coalesce("best.action", F.lit("none")).alias("verdict"), "best.list", "best.pattern", "best.since")
