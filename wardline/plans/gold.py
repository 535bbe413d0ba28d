"""Reporting tables over the enriched alerts.

Every function takes a batch table or a stream. Distinct counts are exact on both by default: entities are
grouped first (which also spreads a busy window over as many tasks as it has entities, after a
map-side combine), then counted. On a stream each result row is emitted once, when the watermark has
passed its window. Where that state, a row per window and entity, is too much, ``distinct="approx"`` keeps one
sketch of bounded size per window instead. Sketches merge, so five-minute ones add up to days
(:func:`entity_sketches`, :func:`daily_entities`), and a single aggregate may also run in update mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import ladders
from wardline.functions.times import iso_date, millis
from wardline.operators.bandjoin import BAND, band_join, whole_seconds

DASHBOARD_WINDOW = "5 minutes"
DAY = "1 day"


def entity_totals(
    rows: DataFrame,
    keys: list[str],
    measures: dict[str, tuple[Column, Callable]],
    sets: tuple[str, ...] = (),
) -> DataFrame:
    """Per ``keys``: the number of distinct ``id`` as ``entities``, every measure, and the sorted set of
    values of every column in ``sets`` (columns with few values, or arrays of them).

    A measure is a pair: its aggregate per entity, and the function that combines entities. The sets
    take part as facets of their own, that is each row also counts once under (no id, its value), which
    a map-side combine reduces to the few values there are. Collecting them per entity instead would
    cost a sort of all rows, since sets do not fit the hash aggregate.
    """
    texts = ("id", *sets)
    facet = ["id"]
    if sets:
        facet = ["facet", *texts]

        def one(number: int, kept: str, value: Column) -> Column:
            return F.struct(F.lit(number).alias("facet"), *[
                (value if name == kept else F.lit(None).cast("string")).alias(name) for name in texts
            ])

        def several(number: int, name: str) -> Column:
            if rows.schema[name].dataType.typeName() == "array":
                return F.transform(name, lambda value: one(number, name, value))
            return F.array(one(number, name, F.col(name)))

        rest = [name for name in rows.columns if name not in texts]
        facets = F.concat(*[several(number, name) for number, name in enumerate(texts)])
        rows = rows.withColumn("facets", F.explode_outer(facets)).select(*rest, "facets.*")
    per_entity = rows.groupBy(*keys, *facet).agg(
        *[column.alias(name) for name, (column, _) in measures.items()]
    )

    def own(name: str) -> Column:
        return F.when(F.col("facet") == 0, F.col(name)) if sets else F.col(name)

    return per_entity.groupBy(*keys).agg(
        F.count("id").alias("entities"),
        *[combine(own(name)).alias(name) for name, (_, combine) in measures.items()],
        *[F.sort_array(F.collect_set(name)).alias(f"{name}s") for name in sets],
    )


# Sketches of 2 ** 14 registers: the standard error of an estimate is 0.8 %, at 16 KB a sketch at most.
SKETCH_BITS = 14


def sketch_totals(
    rows: DataFrame, keys: list[str], measures: dict[str, tuple[Column, Callable]], sets: tuple[str, ...] = ()
) -> DataFrame:
    """What :func:`entity_totals` gives, in one aggregate, with ``entities`` estimated from a sketch of ``id``."""
    return rows.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("id", SKETCH_BITS)).alias("entities"),
        *[column.alias(name) for name, (column, _) in measures.items()],
        *[F.sort_array(F.collect_set(name)).alias(f"{name}s") for name in sets],
    )


_TOTALS = {"exact": entity_totals, "approx": sketch_totals}


def _windowed(
    alerts: DataFrame,
    watermark: str | None,
    length: str,
    slide: str | None,
    dims: list[str],
    sums: dict[str, Column] | None = None,
    times: bool = False,
    sets: tuple[str, ...] = (),
    distinct: str = "exact",
) -> DataFrame:
    """Per event-time window and ``dims``: ``n`` alerts, ``entities`` distinct ids, further sums,
    first and last time, sets, and the window's bounds."""
    if watermark:
        alerts = alerts.withWatermark("event_time", watermark)
    measures = {"n": (F.count("*"), F.sum)}
    for name, column in (sums or {}).items():
        measures[name] = (F.sum(column), F.sum)
    if times:
        measures["first_time"] = (F.min("event_time"), F.min)
        measures["last_time"] = (F.max("event_time"), F.max)
    spans = alerts.withColumn("window", _span(alerts, length, slide))
    return (
        _TOTALS[distinct](spans, ["window", *dims], measures, sets)
        .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        .drop("window")
    )


def _span(alerts: DataFrame, length: str, slide: str | None) -> Column:
    """The event-time window of a row. Alerts without a time have no window, but they do form a day
    of their own in batch tables (on a stream no watermark could ever close it)."""
    if slide:
        return F.window("event_time", length, slide)
    if length == DAY and not alerts.isStreaming:
        start = F.date_trunc("day", F.col("event_time"))
        return F.struct(start.alias("start"), (start + F.expr("INTERVAL 1 DAY")).alias("end"))
    return F.window("event_time", length)


def alert_dashboard(silver: DataFrame, watermark: str | None = "10 minutes", distinct: str = "exact") -> DataFrame:
    """Alerts per five minutes, type and severity."""
    minutes = millis(DASHBOARD_WINDOW) / 60_000
    score = ladders.by_value(F.col("severity"), ladders.SEVERITY_SCORE, 1)
    return _windowed(
        silver, watermark, DASHBOARD_WINDOW, None, ["alert_type", "severity"], distinct=distinct
    ).select(
        "window_start", "window_end", "alert_type", "severity",
        F.col("n").alias("alert_count"),
        F.col("entities").alias("unique_entities"),
        (F.col("n") / F.lit(minutes)).alias("alerts_per_minute"),
        score.alias("severity_score"),
        (F.col("n") * score).alias("risk_score"),
    )


def daily_alert_summary(silver: DataFrame, watermark: str | None = DAY, distinct: str = "exact") -> DataFrame:
    """Alerts per day, type, category and severity."""
    dims = ["alert_type", "alert_category", "severity"]
    weight = ladders.by_value(F.col("severity"), ladders.SEVERITY_WEIGHT, 0)
    return _windowed(silver, watermark, DAY, None, dims, times=True, sets=("rule",), distinct=distinct).select(
        iso_date(F.col("window_start")).alias("date"), *dims,
        F.col("n").alias("total_alerts"),
        F.col("entities").alias("unique_entities_affected"),
        F.col("first_time").alias("first_alert_time"),
        F.col("last_time").alias("last_alert_time"),
        F.col("rules").alias("rules_triggered"),
        (F.col("n") / F.lit(24.0)).alias("alerts_per_hour"),
        weight.alias("severity_weight"),
        (F.col("n") * weight).alias("weighted_risk_score"),
    )


def entity_sketches(silver: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """Per five minutes, type, category and severity the number of alerts and a sketch of their entities."""
    if watermark:
        silver = silver.withWatermark("event_time", watermark)
    dims = ["alert_type", "alert_category", "severity"]
    return (
        silver.groupBy(F.window("event_time", DASHBOARD_WINDOW).alias("window"), *dims)
        .agg(F.count("*").alias("alert_count"), F.hll_sketch_agg("id", SKETCH_BITS).alias("entities_sketch"))
        .select(F.col("window.start").alias("window_start"), *dims, "alert_count", "entities_sketch")
    )


def daily_entities(sketches: DataFrame) -> DataFrame:
    """Days from the windows of :func:`entity_sketches`, without another look at the alerts."""
    dims = ["alert_type", "alert_category", "severity"]
    return sketches.groupBy(iso_date(F.col("window_start")).alias("date"), *dims).agg(
        F.sum("alert_count").alias("total_alerts"),
        F.hll_sketch_estimate(F.hll_union_agg("entities_sketch")).alias("unique_entities_affected"),
    )


PATTERN_WINDOW, PATTERN_SLIDE = "1 hour", "30 minutes"


def alert_patterns(
    silver: DataFrame,
    watermark: str | None = "30 minutes",
    spike_above: int = 5,
    intensity=ladders.PATTERN_INTENSITY,
) -> DataFrame:
    """Alerts per hour (every half hour), rule and type, with spikes marked.

    Whom a pattern affects is a table of its own, :func:`pattern_entities`: as a list inside this
    row it would grow with the number of alerts in the hour, without limit.
    """
    counted = F.col("n")
    return _windowed(
        silver, watermark, PATTERN_WINDOW, PATTERN_SLIDE, ["rule", "alert_type"]
    ).select(
        "window_start", "window_end", "rule", "alert_type",
        counted.alias("pattern_count"),
        F.col("entities").alias("unique_victims"),
        iso_date(F.col("window_start")).alias("pattern_date"),
        F.hour("window_start").alias("pattern_hour"),
        (counted > spike_above).alias("is_spike"),
        ladders.above(counted, intensity, "NORMAL").alias("pattern_intensity"),
    )


def pattern_entities(silver: DataFrame, watermark: str | None = "30 minutes") -> DataFrame:
    """The affected entities of each pattern: one row per entity, with its number of alerts."""
    if watermark:
        silver = silver.withWatermark("event_time", watermark)
    span = F.window("event_time", PATTERN_WINDOW, PATTERN_SLIDE).alias("window")
    return (
        silver.where(F.col("id").isNotNull())
        .groupBy(span, "rule", "alert_type", "id")
        .agg(F.count("*").alias("alerts"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "rule", "alert_type", F.col("id").alias("entity"), "alerts",
        )
    )


def top_entities(entities: DataFrame, most: int = 5) -> DataFrame:
    """Of :func:`pattern_entities`, one row per pattern: its number of ``entities`` and ``alerts``, the ``most`` affected
    entities with their alerts (``top``, most alerts first, then by entity) and what the rest amounts to.

    Each task passes on at most ``most`` rows of a pattern, so that one with a third of all entities fills no task.
    """
    pattern = ["window_start", "window_end", "rule", "alert_type"]
    place = F.row_number().over(Window.partitionBy(*pattern).orderBy(F.desc("alerts"), "entity"))
    one = F.struct("place", "entity", "alerts")
    first = entities.withColumn("place", place).where(F.col("place") <= most).select(
        *pattern, one.alias("one"), F.lit(0).cast("long").alias("entities"), F.lit(0).cast("long").alias("alerts"))
    totals = entities.groupBy(*pattern).agg(F.count("*").alias("entities"), F.sum("alerts").alias("alerts")).select(
        *pattern, F.lit(None).cast(first.schema["one"].dataType).alias("one"), "entities", "alerts")
    rows = first.unionByName(totals).groupBy(*pattern).agg(
        F.sum("entities").alias("entities"), F.sum("alerts").alias("alerts"), F.array_sort(F.collect_list("one")).alias("top"))
    shown = F.aggregate("top", F.lit(0).cast("long"), lambda total, x: total + x["alerts"])
    return rows.select(
        *pattern, "entities", "alerts", F.transform("top", lambda x: F.struct(x["entity"].alias("entity"), x["alerts"].alias("alerts"))).alias("top"),
        (F.col("entities") - F.size("top")).alias("rest_entities"), (F.col("alerts") - shown).alias("rest_alerts"))


def executive_dashboard(silver: DataFrame, watermark: str | None = DAY) -> DataFrame:
    """Key figures per day."""

    def ones(column: str, value: str) -> Column:
        return F.when(F.col(column) == value, 1).otherwise(0)

    sums = {
        "critical_alerts": ones("severity", "CRITICAL"),
        "high_alerts": ones("severity", "HIGH"),
        "medium_alerts": ones("severity", "MEDIUM"),
        "fraud_alerts": ones("alert_type", "FRAUD_TRANSACTION"),
        "insider_alerts": ones("alert_type", "INSIDER_THREAT"),
    }
    total = F.col("n")
    hours = (F.unix_timestamp("last_time") - F.unix_timestamp("first_time")) / 3600
    weighted = sum(
        F.col(f"{severity.lower()}_alerts") * weight for severity, weight in ladders.SEVERITY_WEIGHT
    )
    shares = {
        f"{part}_percentage": F.col(f"{part}_alerts") / total * 100
        for part in ("critical", "fraud", "insider")
    }
    return (
        _windowed(silver, watermark, DAY, None, [], sums, times=True)
        .select(
            iso_date(F.col("window_start")).alias("date"),
            total.alias("total_alerts"),
            F.col("entities").alias("unique_entities"),
            *sums,
            F.col("first_time").alias("first_alert"),
            F.col("last_time").alias("last_alert"),
            hours.alias("alert_duration_hours"),
            F.try_divide(total, hours).alias("alerts_per_hour"),
            *[share.alias(name) for name, share in shares.items()],
            (weighted / total).alias("risk_index"),
        )
        .withColumn(
            "threat_trend", ladders.above(F.col("risk_index"), ladders.THREAT_TREND, "🟢 LOW RISK")
        )
    )


def threat_columns(grouped: DataFrame) -> DataFrame:
    """The combined table from its sums: ``alert_count, cards_involved, actors_involved``, the ``paid``
    total of ``amounts`` amounts, and the sets ``rules`` and ``types``."""
    return grouped.select(
        "date", "alert_type", "severity", "alert_count", "cards_involved", "actors_involved",
        F.col("paid").alias("total_amount_affected"),
        F.try_divide("paid", "amounts").alias("avg_transaction_amount"),
        F.col("rules").alias("active_rules"),
        F.col("types").alias("event_types"),
        ladders.threat_level(F.col("alert_count"), F.col("severity")).alias("threat_level"),
        F.coalesce(F.col("paid") / 1000, F.lit(0.0)).alias("financial_impact_score"),
    )


def combined_threat_analytics(
    silver: DataFrame, fraud: DataFrame, insider: DataFrame, band: str = BAND
) -> DataFrame:
    """Alerts per day, type and severity with the payments and activity of the same entity around them.

    The figures are those of ``alerts ⟕ payments ⟕ activity`` on the time band, so an alert with p
    payments and a activities counts p × a times (at least once). The pairs themselves are never formed.
    Alerts, payments and activities shrink to one row per entity, second and what else they carry, in one
    aggregate. Time is cut into blocks as long as a band, so an alert's band is the end of one block and
    the beginning of the next. A group is an entity and two such neighbours; a total that grows from the
    end of the first block backwards and one that grows from the beginning of the second give an alert
    its counts and sums. They only ever add what lies in the band: nothing is subtracted, so amounts
    outside it, however large or not finite, leave no trace. A group holds no more rows than two blocks
    have seconds, times the kinds of rows.
    """
    reach = millis(band) // 1000 - 1
    length = 2 * reach + 1
    dims = ["date", "alert_type", "severity"]
    totals = ["payments", "paid", "amounts", "activities"]

    # One aggregate over all three kinds: 0 payments, 1 activities, 2 alerts.
    nothing = F.lit(None).cast("string")
    columns = {"type": nothing, "rule": nothing, **dict.fromkeys(dims, nothing), "amount": F.lit(None).cast("double")}

    def rows(frame: DataFrame, kind: int, key: str, **own: Column) -> DataFrame:
        return frame.select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), whole_seconds(F.col("event_time")).alias("at"),
            *[value.alias(name) for name, value in (columns | own).items()],
        )

    paid = rows(fraud, 0, "cardId", amount=F.col("amount"))
    acted = rows(insider, 1, "actor", type=F.col("type"))
    points = paid.union(acted).where(F.col("id").isNotNull() & F.col("at").isNotNull())
    probes = rows(
        silver, 2, "id", rule=F.col("rule"), date=iso_date(F.col("event_time")),
        alert_type=F.col("alert_type"), severity=F.col("severity"),
    )
    merged = points.union(probes).groupBy("kind", "id", "at", "type", "rule", *dims).agg(
        F.count("*").alias("copies"), F.sum("amount").alias("paid"), F.count("amount").alias("amounts"))

    # An alert's band begins in the block that names its group; a point stands in the first block of one
    # group and in the second of the group before.
    is_alert = F.col("kind") == 2
    block = F.floor(F.when(is_alert, F.col("at") - reach).otherwise(F.col("at")) / F.lit(length))
    sides = F.when(is_alert, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    grouped = (
        merged.withColumns({"block": block, "side": F.explode(sides)})
        .withColumn("block", F.col("block") - F.col("side"))
        .withColumn("payments", F.when(F.col("kind") == 0, F.col("copies")))
        .withColumn("activities", F.when(F.col("kind") == 1, F.col("copies")))
    )
    same = Window.partitionBy("id", "block")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    first = F.when(is_alert, F.col("at") - reach).otherwise(F.col("at"))
    last = F.when(is_alert, F.col("at") + reach).otherwise(F.col("at"))
    halves = [same.orderBy(first.desc(), "kind").rowsBetween(*so_far), same.orderBy(last, "kind").rowsBetween(*so_far)]

    def on_side(side: int, value: Column) -> Column:
        return F.when(~is_alert & (F.col("side") == side), value)

    sums = {
        name: sum(F.coalesce(F.sum(on_side(side, F.col(name))).over(half), F.lit(0)) for side, half in enumerate(halves))
        for name in totals
    }
    types = F.array_union(*[F.collect_set(on_side(side, F.col("type"))).over(half) for side, half in enumerate(halves)])
    alert = F.struct("kind", "id", *dims, "rule", F.col("copies").alias("alerts"))
    per_alert = (
        grouped.select(alert.alias("alert"), types.alias("type"), *[value.alias(name) for name, value in sums.items()])
        .where("alert.kind = 2").select("alert.*", "type", *totals)
    )

    repeated = F.col("alerts") * F.greatest("activities", F.lit(1))
    measures = {
        "alert_count": (F.sum(repeated * F.greatest("payments", F.lit(1))), F.sum),
        "paid": (F.sum(F.when(F.col("amounts") > 0, F.col("paid") * repeated)), F.sum),
        "amounts": (F.sum(F.col("amounts") * repeated), F.sum),
        "cards_involved": (F.max((F.col("payments") > 0).cast("int")), F.sum),
        "actors_involved": (F.max((F.col("activities") > 0).cast("int")), F.sum),
    }
    return threat_columns(entity_totals(per_alert, dims, measures, ("rule", "type")))


def alerts_with_payments(silver: DataFrame, fraud: DataFrame, band: str = BAND) -> DataFrame:
    """Each alert with each payment of its entity in the band (``cardId, amount, txn_time``)."""
    return band_join(
        silver, fraud.withColumnRenamed("event_time", "txn_time"), "id", "cardId", "txn_time", band=band
    )


def alerts_with_activity(silver: DataFrame, insider: DataFrame, band: str = BAND) -> DataFrame:
    """Each alert with each activity of its entity in the band (``actor, type, insider_time``)."""
    return band_join(
        silver, insider.withColumnRenamed("event_time", "insider_time"), "id", "actor",
        "insider_time", band=band,
    )
