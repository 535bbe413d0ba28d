"""Mixing sources to target weights.

Tokens are summed per source, targets and repetition rates follow from the sums, and a document is taken
floor(rate) times plus one copy drawn with the remaining fraction as its probability. The draw hashes the
document's id with a seed, so a rerun, a retried task or another partitioning takes the same copies.

Only the per-source table is aggregated (map-side first); documents never move unless there are more sources
than :data:`shared.BROADCAST_ROWS`.

Defined results: a null text has size 0 and is taken as often as its source says; a null source is a source of
its own, last in order; a null id draws like an empty id; repeated rows draw alike; an empty table gives an empty
result. Input columns other than id, text and source are left alone by :func:`mix` and dropped by :func:`copies`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.shared import broadcast_checked, cut, word_count


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on seed and id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target, rate`` from one ``source, source_size`` row per source.

    Sources in code point order (null last) get ``weights`` in turn and share ``share`` times all sizes. No target
    exceeds ``most`` times its source's size; what a source can't take goes to the others by weight. That is one
    water level: with sources ordered by cap per weight, the level found at each row tells whether its cap binds.
    The windows run over one small row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("place"))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    )
    water = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("water.level"))
    return (
        ranked.withColumn("water", water).withColumn("target", target)
        .select("source", "source_size", "target",
                F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    )


def rated(docs: DataFrame, source: str = "source", text: str = "text", **shares) -> DataFrame:
    """The written per-source table of :func:`targets` for ``docs``."""
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), **shares))


def _times(rate: Column, doc_id: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(doc_id, seed) < rate - whole).cast("long")).cast("long")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           seed: str = "mix", **shares) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, rate, copies``."""
    rates = rated(docs, source, text, **shares)
    rows = docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).alias("of"))
    return (
        rows.join(broadcast_checked(rates), F.col("of").eqNullSafe(F.col("source")))
        .select("doc_id", "size", "source_size", "target", "rate",
                _times(F.col("rate"), F.col("doc_id"), seed).alias("copies"))
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        seed: str = "mix", **shares) -> DataFrame:
    """The rows of ``docs``, with their columns, as often as the mix takes them."""
    rates = rated(docs, source, text, **shares).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"))
    taken = F.sequence(F.lit(1), _times(F.col("_mix_rate"), F.col(doc_id), seed).cast("int"))
    held = docs.join(broadcast_checked(rates), F.col(source).eqNullSafe(F.col("_mix_source")))
    several = held.withColumn("_mix_times", _times(F.col("_mix_rate"), F.col(doc_id), seed)).where("_mix_times > 0")
    return several.withColumn("_mix_copy", F.explode(taken)).select(*docs.columns)
