"""

``queries()[name](spark, sf_dir)`` runs over the whole of the given tables. Results show timestamps as
epoch milliseconds, arrays as comma-separated text and floating-point numbers with six decimals, so
that they compare with ``oracle_sql()[name]`` (same columns, same types).

The events table is read as payment topic, insider topic and alert feed (``wardline.sources.adapters``).
The detection thresholds are arguments; those used here (a payment under 20, then one over 60, within
a day) are chosen because the usual ones match nothing in this table.
"""

from __future__ import annotations

import importlib
import sys
import warnings
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import model_versions, scoring
from wardline.operators.decode import (
    broken_values, decode_events, encode_alerts, with_event_time,
)
from wardline.operators.quality import ALERT_RULES, EVENT_RULES, violation_counts
from wardline.operators.sequence import (
    insider_exfil, match_sequence, sequence_steps, sequence_timeouts, small_then_large, to_alerts,
)
from wardline.plans import alerts as alert_plans
from wardline.plans import events as event_plans
from wardline.plans import gold, incremental, reports
from wardline.plans.medallion import Tables
from wardline.session import configure, scratch_path
from wardline.sources import adapters
from wardline.streaming import combined, upserts
from wardline.streaming.models import score_stream_by_version
from wardline.streaming.runs import drain, write_stream
from wardline.streaming.sequence import match_sequence_stream, sequence_outcomes_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PAIR = small_then_large(20, 60, "1 day")
PAIR_WITH_SKIPS = small_then_large(20, 60, "1 day", skip=True)
TRIPLE = insider_exfil("1 day")
LATE = "1 hour"
AS_OF = "2024-01-30 20:30:00"
DEFAULT_TS = 1704067200000
MODEL = scoring.LinearModel((4.0, 0.25), -3.0, (50.0, 11.5), (50.0, 7.0))


def entry(spark: SparkSession) -> DataFrame:
    """Small payments followed at once by a large one, per card."""
    return queries()["small_then_large"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _query(name: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)`` under ``name``, shown in comparable form."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _comparable(build(configure(spark), sf_dir))

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def _comparable(rows: DataFrame) -> DataFrame:
    def shown(name: str, kind: str):
        column = F.col(name)
        if kind == "timestamp":
            column = F.unix_millis(column)
        elif kind.startswith("array"):
            column = F.array_join(column, ",")
        elif kind == "double":
            column = F.round(column, 6)
        return column.alias(name)

    return rows.select(*[shown(name, kind) for name, kind in rows.dtypes])


# --- inputs -----------------------------------------------------------------------------------------


def _source(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.read_table(spark, folder)


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.stream_table(spark, folder)


def _replay(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.replay(spark, folder, scratch_path(spark, "replay"))


def _silver_alerts(source: DataFrame) -> DataFrame:
    return alert_plans.silver_alerts(with_event_time(adapters.alert_feed(source)))


def _features(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        event_plans.features_fraud(adapters.auth_txn(source)),
        event_plans.features_insider(adapters.insider_events(source)),
    )


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over the whole table into a written table, under the shared folder."""
    spark = stream.sparkSession
    return drain(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))


def _replayed(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """The same for a replay, whose flush rows make the stream emit everything and are then left out."""
    return adapters.without_flush(_drained(stream, name), _source(stream.sparkSession, folder))


# --- SQL building blocks ----------------------------------------------------------------------------

_DOMAIN = """
dom AS (
  SELECT CASE event_type WHEN 'purchase' THEN 'TXN' WHEN 'signup' THEN 'PRIV_ESC'
              WHEN 'view' THEN 'BULK_EXPORT' WHEN 'click' THEN 'EXT_SHARE' ELSE 'ERROR' END AS type,
         CAST(user_id AS VARCHAR) AS who, value, epoch_us(ts) // 1000 AS ts, event_id AS seq
  FROM events)"""

_SILVER = """
feed AS (
  SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS ts,
         CASE event_type WHEN 'purchase' THEN 'SMALL_THEN_LARGE' WHEN 'click' THEN 'INSIDER_EXFIL'
                         ELSE 'FRAUD_OTHER' END AS rule
  FROM events WHERE event_type IN ('purchase', 'click', 'error')),
silver AS (
  SELECT *, make_timestamp(ts * 1000) AS moment,
         strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS date,
         CASE rule WHEN 'SMALL_THEN_LARGE' THEN 'FRAUD_TRANSACTION'
                   WHEN 'INSIDER_EXFIL' THEN 'INSIDER_THREAT' ELSE 'UNKNOWN' END AS alert_type,
         CASE rule WHEN 'INSIDER_EXFIL' THEN 'CRITICAL' WHEN 'SMALL_THEN_LARGE' THEN 'HIGH'
                   ELSE 'MEDIUM' END AS severity,
         CASE rule WHEN 'FRAUD_OTHER' THEN 'Financial Fraud' WHEN 'INSIDER_EXFIL' THEN 'Insider Threat'
                   ELSE 'Security Event' END AS alert_category
  FROM feed)"""

_DASHBOARD = f"""{_SILVER},
fives AS (
  SELECT ts // 300000 * 300000 AS window_start, alert_type, severity, count(*) AS alert_count,
         count(DISTINCT id) AS unique_entities
  FROM silver GROUP BY ts // 300000 * 300000, alert_type, severity),
dashboard AS (
  SELECT window_start, window_start + 300000 AS window_end, alert_type, severity, alert_count,
         unique_entities, round(alert_count / 5.0, 6) AS alerts_per_minute, severity_score,
         alert_count * severity_score AS risk_score
  FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4
                  ELSE 1 END AS severity_score FROM fives))"""

_DAILY = f"""{_SILVER},
days AS (
  SELECT date, alert_type, alert_category, severity, count(*) AS total_alerts,
         count(DISTINCT id) AS unique_entities_affected, min(ts) AS first_alert_time,
         max(ts) AS last_alert_time, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules_triggered
  FROM silver GROUP BY date, alert_type, alert_category, severity),
daily AS (
  SELECT *, round(total_alerts / 24.0, 6) AS alerts_per_hour,
         total_alerts * severity_weight AS weighted_risk_score
  FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1
                  ELSE 0 END AS severity_weight FROM days))"""

_HOURS = f"""{_SILVER},
hours AS (
  SELECT *, ts // 1800000 * 1800000 - back * 1800000 AS window_start
  FROM silver, (VALUES (0), (1)) AS v(back))"""

_PATTERNS = f"""{_HOURS},
counted AS (
  SELECT window_start, window_start + 3600000 AS window_end, rule, alert_type,
         count(*) AS pattern_count, count(DISTINCT id) AS unique_victims
  FROM hours GROUP BY window_start, rule, alert_type),
patterns AS (
  SELECT *, strftime(make_timestamp(window_start * 1000), '%Y-%m-%d') AS pattern_date,
         CAST(hour(make_timestamp(window_start * 1000)) AS INTEGER) AS pattern_hour,
         pattern_count > 5 AS is_spike,
         CASE WHEN pattern_count > 10 THEN 'HIGH_SPIKE' WHEN pattern_count > 5 THEN 'MODERATE_SPIKE'
              ELSE 'NORMAL' END AS pattern_intensity
  FROM counted)"""

_EXECUTIVE = f"""{_SILVER},
kpi AS (
  SELECT date, count(*) AS total_alerts, count(DISTINCT id) AS unique_entities,
         count(*) FILTER (severity = 'CRITICAL') AS critical_alerts,
         count(*) FILTER (severity = 'HIGH') AS high_alerts,
         count(*) FILTER (severity = 'MEDIUM') AS medium_alerts,
         count(*) FILTER (alert_type = 'FRAUD_TRANSACTION') AS fraud_alerts,
         count(*) FILTER (alert_type = 'INSIDER_THREAT') AS insider_alerts,
         min(ts) AS first_alert, max(ts) AS last_alert
  FROM silver GROUP BY date),
kpis AS (
  SELECT *, (last_alert // 1000 - first_alert // 1000) / 3600.0 AS hours,
         (critical_alerts * 3 + high_alerts * 2 + medium_alerts) / total_alerts AS risk FROM kpi),
executive AS (
  SELECT * EXCLUDE (hours, risk), round(hours, 6) AS alert_duration_hours,
         CASE WHEN hours > 0 THEN round(total_alerts / hours, 6) END AS alerts_per_hour,
         critical_alerts / total_alerts * 100 AS critical_percentage,
         fraud_alerts / total_alerts * 100 AS fraud_percentage,
         insider_alerts / total_alerts * 100 AS insider_percentage,
         risk AS risk_index,
         CASE WHEN risk > 2.0 THEN '🔴 HIGH RISK' WHEN risk > 1.0 THEN '🟡 MEDIUM RISK'
              ELSE '🟢 LOW RISK' END AS threat_trend
  FROM kpis)"""
_EXECUTIVE_ROUNDED = """SELECT * REPLACE (
  round(critical_percentage, 6) AS critical_percentage, round(fraud_percentage, 6) AS fraud_percentage,
  round(insider_percentage, 6) AS insider_percentage, round(risk_index, 6) AS risk_index)
FROM executive"""

_PAYMENT_JOIN = f"""{_DOMAIN}, {_SILVER},
paid AS (
  SELECT s.*, t.who AS card, t.value AS amount, t.ts AS txn_time
  FROM silver s LEFT JOIN dom t
    ON t.type = 'TXN' AND t.who = s.id AND abs(s.ts // 1000 - t.ts // 1000) < 3600)"""

_COMBINED = f"""{_PAYMENT_JOIN},
joined AS (
  SELECT p.*, i.who AS actor, i.type AS type
  FROM paid p LEFT JOIN dom i
    ON i.type IN ('PRIV_ESC', 'BULK_EXPORT', 'EXT_SHARE') AND i.who = p.id
   AND abs(p.ts // 1000 - i.ts // 1000) < 3600),
threats AS (
  SELECT date, alert_type, severity, count(*) AS alert_count, count(DISTINCT card) AS cards_involved,
         count(DISTINCT actor) AS actors_involved, sum(amount) AS total_amount_affected,
         avg(amount) AS avg_transaction_amount,
         string_agg(DISTINCT rule, ',' ORDER BY rule) AS active_rules,
         coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') AS event_types
  FROM joined GROUP BY date, alert_type, severity),
combined AS (
  SELECT *,
         CASE WHEN alert_count > 10 AND severity = 'CRITICAL' THEN 'SEVERE'
              WHEN alert_count > 5 AND severity IN ('HIGH', 'CRITICAL') THEN 'HIGH'
              WHEN alert_count > 2 THEN 'MODERATE' ELSE 'LOW' END AS threat_level,
         coalesce(total_amount_affected / 1000, 0.0) AS financial_impact_score
  FROM threats)"""
_COMBINED_ROUNDED = """SELECT * REPLACE (
  round(total_amount_affected, 6) AS total_amount_affected,
  round(avg_transaction_amount, 6) AS avg_transaction_amount,
  round(financial_impact_score, 6) AS financial_impact_score)
FROM combined"""

def _pair_sql(events: str, strict: bool) -> str:
    """Two-step matches over ``events`` (who, type, value, ts, seq)."""
    if strict:
        after = """SELECT *, lead(type) OVER w AS type2, lead(value) OVER w AS value2,
                          lead(ts) OVER w AS end_ts
                   FROM picked WINDOW w AS (PARTITION BY who ORDER BY ts, seq)"""
        hit = "type2 = 'TXN' AND value2 > 60"
    else:
        after = """SELECT *, min(CASE WHEN type = 'TXN' AND value > 60 THEN ts END) OVER (
                     PARTITION BY who ORDER BY ts, seq
                     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ts FROM picked"""
        hit = "end_ts IS NOT NULL"
    return f"""WITH {_DOMAIN}, picked AS ({events}), after AS ({after})
SELECT who AS id, 'SMALL_THEN_LARGE' AS rule, end_ts AS ts, ts AS first_ts, seq AS first_seq FROM after
WHERE type = 'TXN' AND value < 20 AND {hit} AND end_ts < ts + 86400000"""


def _triple_sql(events: str) -> str:
    return f"""WITH {_DOMAIN}, picked AS ({events}), after AS (
  SELECT *, lead(type, 1) OVER w AS type2, lead(type, 2) OVER w AS type3, lead(ts, 2) OVER w AS end_ts
  FROM picked WINDOW w AS (PARTITION BY who ORDER BY ts, seq))
SELECT who AS id, 'INSIDER_EXFIL' AS rule, end_ts AS ts, ts AS first_ts, seq AS first_seq FROM after
WHERE type = 'PRIV_ESC' AND type2 = 'BULK_EXPORT' AND type3 = 'EXT_SHARE'
  AND end_ts < ts + 86400000"""


_TXN_ONLY = "SELECT * FROM dom WHERE type = 'TXN'"
_INSIDER_ONLY = "SELECT * FROM dom WHERE type IN ('PRIV_ESC', 'BULK_EXPORT', 'EXT_SHARE')"
_EVERYTHING = "SELECT * FROM dom"


# --- decoding, quality, feature tables --------------------------------------------------------------


_RAW_FIELDS = """
raw AS (
  SELECT event_id AS seq, event_type, CAST(user_id AS VARCHAR) AS who, value, epoch_us(ts) // 1000 AS ts
  FROM events)"""


@_query("decode_strict", f"""WITH {_RAW_FIELDS}
SELECT seq,
  CASE event_type WHEN 'purchase' THEN 'TXN' WHEN 'click' THEN 'EXT_SHARE' WHEN 'view' THEN 'BULK_EXPORT'
       ELSE 'PRIV_ESC' END AS type,
  CASE WHEN event_type = 'purchase' THEN who ELSE '' END AS "cardId",
  CASE WHEN event_type IN ('purchase', 'click') THEN round(value, 6) ELSE 0.0 END AS amount,
  CASE WHEN event_type IN ('click', 'view') THEN who ELSE '' END AS actor,
  CASE WHEN event_type = 'signup' THEN {DEFAULT_TS} ELSE ts END AS ts
FROM raw WHERE event_type <> 'error'""")
def _decode_strict(spark, folder):
    raw = adapters.as_json(_source(spark, folder))
    return decode_events(raw, "strict", default_ts=F.lit(DEFAULT_TS).cast("long"))


@_query("decode_broken", """
SELECT event_id AS seq, '{"type":"TXN","cardId":"' || CAST(user_id AS VARCHAR) AS value
FROM events WHERE event_type = 'error'""")
def _decode_broken(spark, folder):
    return broken_values(adapters.as_json(_source(spark, folder)))


_LENIENT = f"""{_RAW_FIELDS},
lenient AS (
  SELECT seq,
    CASE event_type WHEN 'purchase' THEN 'TXN' WHEN 'click' THEN 'EXT_SHARE'
         WHEN 'view' THEN 'BULK_EXPORT' WHEN 'signup' THEN 'PRIV_ESC' END AS type,
    CASE WHEN event_type = 'purchase' THEN who END AS "cardId",
    CASE WHEN event_type = 'purchase' THEN round(value, 6) END AS amount,
    CASE WHEN event_type IN ('click', 'view') THEN who END AS actor,
    CASE WHEN event_type = 'purchase' THEN ts END AS ts
  FROM raw)"""


@_query("decode_lenient", f"WITH {_LENIENT} SELECT * FROM lenient")
def _decode_lenient(spark, folder):
    return decode_events(adapters.as_json(_source(spark, folder)), "lenient")


@_query("bronze_events", f"""WITH {_LENIENT} SELECT * FROM lenient WHERE type IS NOT NULL""")
def _bronze_events(spark, folder):
    return event_plans.bronze_events(adapters.as_json(_source(spark, folder)))


@_query("silver_events", f"""WITH {_LENIENT}
SELECT *, ts AS event_time FROM lenient WHERE type IS NOT NULL""")
def _silver_events(spark, folder):
    return event_plans.silver_events(_bronze_events(spark, folder))


@_query("features_fraud", f"""WITH {_DOMAIN}
SELECT who AS "cardId", round(value, 6) AS amount, ts AS event_time FROM dom WHERE type = 'TXN'""")
def _features_fraud(spark, folder):
    return _features(_source(spark, folder))[0]


@_query("features_insider", f"""WITH {_DOMAIN}
SELECT who AS actor, type, ts AS event_time FROM dom
WHERE type IN ('PRIV_ESC', 'BULK_EXPORT', 'EXT_SHARE')""")
def _features_insider(spark, folder):
    return _features(_source(spark, folder))[1]


@_query("dq_metrics", f"""WITH {_LENIENT}
SELECT 'has_ts' AS rule, 'keep' AS action, count(*) AS rows, count(*) FILTER (ts IS NULL) AS violations
FROM lenient
UNION ALL
SELECT 'valid_type', 'drop', count(*), count(*) FILTER (type IS NULL) FROM lenient
UNION ALL
SELECT 'has_cardId', 'keep', count(*), count(*) FILTER ("cardId" IS NULL) FROM lenient
UNION ALL
SELECT 'valid_alert', 'keep', count(*), count(*) FILTER (event_type IN ('signup', 'view')) FROM events""")
def _dq_metrics(spark, folder):
    source = _source(spark, folder)
    events = decode_events(adapters.as_json(source), "lenient")
    return violation_counts(events, EVENT_RULES, missing_key="cardId").unionByName(
        violation_counts(adapters.alert_feed_with_gaps(source), ALERT_RULES)
    )


# --- sequences --------------------------------------------------------------------------------------


@_query("small_then_large", _pair_sql(_TXN_ONLY, strict=True))
def _small_then_large(spark, folder):
    return match_sequence(adapters.auth_txn(_source(spark, folder)), PAIR)


@_query("small_then_large_all_types", _pair_sql(_EVERYTHING, strict=True))
def _small_then_large_all_types(spark, folder):
    return match_sequence(adapters.all_activity(_source(spark, folder)), PAIR)


@_query("insider_exfil", _triple_sql(_INSIDER_ONLY))
def _insider_exfil(spark, folder):
    return match_sequence(adapters.insider_events(_source(spark, folder)), TRIPLE)


@_query("insider_exfil_all_types", _triple_sql(_EVERYTHING))
def _insider_exfil_all_types(spark, folder):
    return match_sequence(adapters.all_activity(_source(spark, folder)), TRIPLE)


@_query("followed_by", _pair_sql(_EVERYTHING, strict=False))
def _followed_by(spark, folder):
    return match_sequence(adapters.all_activity(_source(spark, folder)), PAIR_WITH_SKIPS)


def _nearest(column, condition):
    return f"""first_value(CASE WHEN {condition} THEN {column} END IGNORE NULLS) OVER (
    PARTITION BY who ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


_LARGE = "type = 'TXN' AND value > 60"


@_query("followed_by_steps", f"""WITH {_DOMAIN}, after AS (
  SELECT *, {_nearest("ts", _LARGE)} AS end_ts, {_nearest("seq", _LARGE)} AS end_seq, {_nearest("value", _LARGE)} AS end_value FROM dom)
SELECT who AS id, 'SMALL_THEN_LARGE' AS rule, end_ts AS ts, ts AS first_ts, seq AS first_seq, end_seq AS last_seq,
       round(value, 6) AS small, round(end_value, 6) AS large, 'small,large' AS steps
FROM after WHERE type = 'TXN' AND value < 20 AND end_ts < ts + 86400000""")
def _followed_by_steps(spark, folder):
    found = sequence_steps(adapters.all_activity(_source(spark, folder)), PAIR_WITH_SKIPS, "amount")
    first, last = F.col("steps")[0], F.col("steps")[1]
    return found.select(
        "id", "rule", "ts", "first_ts", "first_seq", last["seq"].alias("last_seq"), F.round(first["amount"], 6).alias("small"),
        F.round(last["amount"], 6).alias("large"), F.array_join("steps.step", ",").alias("steps"))


@_query("insider_exfil_steps", f"""WITH {_DOMAIN}, after AS (
  SELECT *, lead(type, 1) OVER w AS type2, lead(type, 2) OVER w AS type3, lead(ts, 2) OVER w AS ts3,
         lead(ts, 1) OVER w AS ts2, lead(seq, 1) OVER w AS seq2, lead(seq, 2) OVER w AS seq3
  FROM ({_INSIDER_ONLY}) WINDOW w AS (PARTITION BY who ORDER BY ts, seq))
SELECT who AS id, 'INSIDER_EXFIL' AS rule, ts3 AS ts, ts AS first_ts, seq AS first_seq,
       concat_ws(',', ts, ts2, ts3) AS times, concat_ws(',', seq, seq2, seq3) AS seqs, 'PRIV_ESC,BULK_EXPORT,EXT_SHARE' AS types
FROM after WHERE type = 'PRIV_ESC' AND type2 = 'BULK_EXPORT' AND type3 = 'EXT_SHARE' AND ts3 < ts + 86400000""")
def _insider_exfil_steps(spark, folder):
    found = sequence_steps(adapters.insider_events(_source(spark, folder)), TRIPLE, "type")
    return found.select("id", "rule", "ts", "first_ts", "first_seq", *[
        F.array_join(F.col(f"steps.{name}").cast("array<string>"), ",").alias(shown)
        for name, shown in (("ts", "times"), ("seq", "seqs"), ("type", "types"))])


@_query("sequence_timeouts", f"""WITH {_DOMAIN}, after AS (
  SELECT *, lead(type, 1) OVER w AS type2, lead(ts, 1) OVER w AS ts2, lead(ts, 2) OVER w AS ts3
  FROM ({_INSIDER_ONLY}) WINDOW w AS (PARTITION BY who ORDER BY ts, seq)),
open AS (
  SELECT *, CASE WHEN ts2 IS NULL OR ts2 >= ts + 86400000 THEN 'bulk_export'
                 WHEN type2 = 'BULK_EXPORT' AND (ts3 IS NULL OR ts3 >= ts + 86400000) THEN 'ext_share' END AS waited_for
  FROM after WHERE type = 'PRIV_ESC')
SELECT who AS id, 'INSIDER_EXFIL' AS rule, ts + 86400000 AS ts, ts AS first_ts, seq AS first_seq, waited_for
FROM open WHERE waited_for IS NOT NULL""")
def _sequence_timeouts(spark, folder):
    return sequence_timeouts(adapters.insider_events(_source(spark, folder)), TRIPLE)


@_query("followed_by_timeouts", f"""WITH {_DOMAIN}, after AS (
  SELECT *, min(CASE WHEN type = 'TXN' AND value > 60 THEN ts END) OVER (
    PARTITION BY who ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ts FROM dom)
SELECT who AS id, 'SMALL_THEN_LARGE' AS rule, ts + 86400000 AS ts, ts AS first_ts, seq AS first_seq, 'large' AS waited_for
FROM after WHERE type = 'TXN' AND value < 20 AND (end_ts IS NULL OR end_ts >= ts + 86400000)""")
def _followed_by_timeouts(spark, folder):
    return sequence_timeouts(adapters.all_activity(_source(spark, folder)), PAIR_WITH_SKIPS)


_ALL_ALERTS = f"""
SELECT id, rule, ts FROM ({_pair_sql(_TXN_ONLY, strict=True)})
UNION ALL SELECT id, rule, ts FROM ({_triple_sql(_INSIDER_ONLY)})"""


def _all_alerts(spark, folder):
    return to_alerts(_small_then_large(spark, folder)).unionByName(to_alerts(_insider_exfil(spark, folder)))


@_query("alerts_all", _ALL_ALERTS)
def _alerts_all(spark, folder):
    return _all_alerts(spark, folder)


@_query("alert_encode", f"""
SELECT id AS key, '{{"id":"' || id || '","rule":"' || rule || '","ts":' || CAST(ts AS VARCHAR) || '}}'
  AS value FROM ({_ALL_ALERTS})""")
def _alert_encode(spark, folder):
    return encode_alerts(_all_alerts(spark, folder))


# --- alerts -----------------------------------------------------------------------------------------


@_query("bronze_alerts", f"""SELECT id, rule, ts, ts AS event_time FROM ({_ALL_ALERTS})""")
def _bronze_alerts(spark, folder):
    return alert_plans.bronze_alerts(encode_alerts(_all_alerts(spark, folder), key=False)).drop("ingestion_ts")


@_query("silver_alerts", f"""WITH {_SILVER}
SELECT id, rule, ts, ts AS event_time, alert_type, severity, alert_category,
  CASE severity WHEN 'CRITICAL' THEN 'High - Immediate Response Required'
    WHEN 'HIGH' THEN 'Medium - Investigation Needed' ELSE 'Low - Monitor' END AS business_impact,
  CAST(year(moment) AS INTEGER) AS year, CAST(month(moment) AS INTEGER) AS month,
  CAST(day(moment) AS INTEGER) AS day, CAST(hour(moment) AS INTEGER) AS hour
FROM silver""")
def _silver(spark, folder):
    return _silver_alerts(_source(spark, folder))


@_query("silver_alerts_compacted", _SQL["silver_alerts"])
def _silver_compacted(spark, folder):
    """A stream appends the first half of the time, its table is compacted, and the same stream appends the rest."""
    table, root = _source(spark, folder), scratch_path(spark, "compacted")
    tables, arriving = Tables(root), f"{root}/arriving"
    first, last = table.agg(F.min("ts"), F.max("ts")).first()
    early = F.lit(True) if last is None else F.col("ts").isNull() | (F.col("ts") < F.lit(first + (last - first) / 2))
    for part in (early, ~early):
        table.where(part).write.mode("append").parquet(arriving)
        silver = _silver_alerts(spark.readStream.schema(table.schema).parquet(arriving))
        write_stream(silver, tables.path("silver_alerts"), f"{root}/checkpoint", every=None).awaitTermination()
        if part is early:
            tables.compact(spark, "silver_alerts", silver.schema)
    return tables.read_compacted(spark, "silver_alerts", silver.schema)


@_query("alerts_join_txn", f"""WITH {_PAYMENT_JOIN}
SELECT id, rule, ts, card AS "cardId", round(amount, 6) AS amount, txn_time FROM paid""")
def _alerts_join_txn(spark, folder):
    source = _source(spark, folder)
    joined = gold.alerts_with_payments(_silver_alerts(source), _features(source)[0])
    return joined.select("id", "rule", "ts", "cardId", "amount", "txn_time")


@_query("alerts_join_insider", f"""WITH {_DOMAIN}, {_SILVER}
SELECT s.id, s.rule, s.ts, i.who AS actor, i.type, i.ts AS insider_time
FROM silver s LEFT JOIN dom i ON i.type IN ('PRIV_ESC', 'BULK_EXPORT', 'EXT_SHARE')
  AND i.who = s.id AND abs(s.ts // 1000 - i.ts // 1000) < 3600""")
def _alerts_join_insider(spark, folder):
    source = _source(spark, folder)
    joined = gold.alerts_with_activity(_silver_alerts(source), _features(source)[1])
    return joined.select("id", "rule", "ts", "actor", "type", "insider_time")


# --- gold tables ------------------------------------------------------------------------------------


@_query("gold_alert_dashboard", f"WITH {_DASHBOARD} SELECT * FROM dashboard")
def _dashboard(spark, folder):
    return gold.alert_dashboard(_silver(spark, folder))


@_query("gold_daily_alert_summary", f"WITH {_DAILY} SELECT * FROM daily")
def _daily(spark, folder):
    return gold.daily_alert_summary(_silver(spark, folder))


@_query("gold_alert_patterns", f"WITH {_PATTERNS} SELECT * FROM patterns")
def _patterns(spark, folder):
    return gold.alert_patterns(_silver(spark, folder))


_ENTITIES_SQL = f"""{_HOURS},
entities AS (
  SELECT window_start, window_start + 3600000 AS window_end, rule, alert_type, id AS entity,
         count(*) AS alerts FROM hours GROUP BY window_start, rule, alert_type, id)"""


@_query("gold_alert_pattern_entities", f"WITH {_ENTITIES_SQL} SELECT * FROM entities")
def _pattern_entities(spark, folder):
    return gold.pattern_entities(_silver(spark, folder))


@_query("gold_alert_pattern_top_entities", f"""WITH {_ENTITIES_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY window_start, rule, alert_type ORDER BY alerts DESC, entity) AS place FROM entities)
SELECT window_start, window_end, rule, alert_type, count(*) AS entities, CAST(sum(alerts) AS BIGINT) AS alerts,
       string_agg(entity || ':' || alerts, ',' ORDER BY place) FILTER (place <= 3) AS top,
       count(*) FILTER (place > 3) AS rest_entities, CAST(coalesce(sum(alerts) FILTER (place > 3), 0) AS BIGINT) AS rest_alerts
FROM placed GROUP BY window_start, window_end, rule, alert_type""")
def _pattern_top_entities(spark, folder):
    found = gold.top_entities(gold.pattern_entities(_silver(spark, folder)), most=3)
    shown = F.transform("top", lambda x: F.concat_ws(":", x["entity"], x["alerts"].cast("string")))
    return found.withColumn("top", F.array_join(shown, ","))


@_query("gold_combined_threat", f"WITH {_COMBINED} {_COMBINED_ROUNDED}")
def _combined(spark, folder):
    source = _source(spark, folder)
    return gold.combined_threat_analytics(_silver_alerts(source), *_features(source))


@_query("gold_executive_dashboard", f"WITH {_EXECUTIVE} {_EXECUTIVE_ROUNDED}")
def _executive(spark, folder):
    return gold.executive_dashboard(_silver(spark, folder))


# --- reports ----------------------------------------------------------------------------------------
# Built over the events that their period needs, a filter on the raw time that reaches the scan.

AN_HOUR_AGO, THIS_HOUR, A_WEEK_AGO, A_MONTH_AGO = (
    "2024-01-30 19:30:00", "2024-01-30 20:00:00", "2024-01-23 00:00:00", "2023-12-31 00:00:00")


def _recent_silver(spark, folder, moment):
    return _silver_alerts(adapters.since(_source(spark, folder), moment))


_WEEK = "strftime(DATE '2024-01-30' - INTERVAL 7 DAY, '%Y-%m-%d')"
_MONTH = "strftime(DATE '2024-01-30' - INTERVAL 30 DAY, '%Y-%m-%d')"


@_query("report_dashboard_last_hour", f"""WITH {_DASHBOARD}
SELECT window_start, alert_type, severity, alert_count, risk_score FROM dashboard
WHERE window_start >= epoch_ms(TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) ORDER BY window_start DESC""")
def _report_dashboard(spark, folder):
    return reports.dashboard_last_hour(gold.alert_dashboard(_recent_silver(spark, folder, AN_HOUR_AGO)), AS_OF)


@_query("report_daily_7d", f"""WITH {_DAILY}
SELECT date, alert_type, total_alerts, severity, weighted_risk_score FROM daily WHERE date >= {_WEEK}
ORDER BY date DESC, weighted_risk_score DESC""")
def _report_daily(spark, folder):
    return reports.daily_summary_week(gold.daily_alert_summary(_recent_silver(spark, folder, A_WEEK_AGO)), AS_OF)


@_query("report_spikes", f"""WITH {_PATTERNS}
SELECT pattern_date, rule, pattern_count, pattern_intensity, is_spike FROM patterns WHERE is_spike
ORDER BY pattern_count DESC""")
def _report_spikes(spark, folder):
    return reports.spikes(_patterns(spark, folder))


@_query("report_executive_30d", f"""WITH {_EXECUTIVE}
SELECT date, total_alerts, round(critical_percentage, 6) AS critical_percentage,
       round(risk_index, 6) AS risk_index, threat_trend
FROM executive WHERE date >= {_MONTH} ORDER BY date DESC""")
def _report_executive(spark, folder):
    return reports.executive_month(gold.executive_dashboard(_recent_silver(spark, folder, A_MONTH_AGO)), AS_OF)


@_query("report_current_hour", f"""WITH {_DASHBOARD}
SELECT strftime(make_timestamp(window_start * 1000), '%H:%M') AS time_window, alert_type, severity,
       CAST(sum(alert_count) AS BIGINT) AS total_alerts, round(avg(risk_score), 6) AS avg_risk_score
FROM dashboard WHERE window_start >= epoch_ms(date_trunc('hour', TIMESTAMP '{AS_OF}'))
GROUP BY window_start, alert_type, severity ORDER BY window_start DESC""")
def _report_current_hour(spark, folder):
    return reports.current_hour(gold.alert_dashboard(_recent_silver(spark, folder, THIS_HOUR)), AS_OF)


@_query("report_risk_trend_7d", f"""WITH {_EXECUTIVE}
SELECT date, total_alerts, round(critical_percentage, 2) AS critical_pct,
       round(fraud_percentage, 2) AS fraud_pct, round(insider_percentage, 2) AS insider_pct,
       round(risk_index, 2) AS risk_index, threat_trend
FROM executive WHERE date >= {_WEEK} ORDER BY date DESC""")
def _report_risk_trend(spark, folder):
    return reports.risk_trend_week(gold.executive_dashboard(_recent_silver(spark, folder, A_WEEK_AGO)), AS_OF)


@_query("report_top_patterns", f"""WITH {_PATTERNS}
SELECT rule, count(*) AS occurrences, count(DISTINCT pattern_date) AS active_days,
       round(avg(pattern_count), 6) AS avg_daily_alerts, max(pattern_count) AS peak_alerts
FROM patterns WHERE pattern_date >= {_WEEK} AND pattern_intensity IN ('HIGH_SPIKE', 'MODERATE_SPIKE')
GROUP BY rule ORDER BY occurrences DESC""")
def _report_top_patterns(spark, folder):
    return reports.top_patterns_week(gold.alert_patterns(_recent_silver(spark, folder, A_WEEK_AGO)), AS_OF)


@_query("report_fraud_vs_insider", f"""WITH {_COMBINED}
SELECT date, alert_type, CAST(sum(alert_count) AS BIGINT) AS alerts,
       CAST(sum(cards_involved) AS BIGINT) AS cards_affected,
       CAST(sum(actors_involved) AS BIGINT) AS actors_involved,
       round(sum(total_amount_affected), 2) AS total_amount, threat_level
FROM combined WHERE date >= {_MONTH}
GROUP BY date, alert_type, threat_level ORDER BY date DESC, alerts DESC""")
def _report_fraud_vs_insider(spark, folder):
    # Payments and activity count for alerts up to an hour away.
    source = adapters.since(_source(spark, folder), "2023-12-30 23:00:00")
    alerts = adapters.since(_source(spark, folder), A_MONTH_AGO)
    table = gold.combined_threat_analytics(_silver_alerts(alerts), *_features(source))
    return reports.fraud_vs_insider_month(table, AS_OF)


# --- model ------------------------------------------------------------------------------------------


@_query("training_set", f"""WITH {_DOMAIN}
SELECT round(value, 6) AS amount, CAST(hour(make_timestamp(ts * 1000)) AS INTEGER) AS hour,
       CASE WHEN value > 120 THEN 1.0 ELSE 0.0 END::DOUBLE AS label
FROM dom WHERE type = 'TXN' AND value IS NOT NULL""")
def _training_set(spark, folder):
    return scoring.training_set(_features(_source(spark, folder))[0])


@_query("feature_stats", f"""WITH {_DOMAIN},
t AS (SELECT value AS amount, hour(make_timestamp(ts * 1000)) AS hour FROM dom
      WHERE type = 'TXN' AND value IS NOT NULL)
SELECT count(*) AS n, round(avg(amount), 6) AS amount_mean, round(avg(hour), 6) AS hour_mean,
       round(stddev_samp(amount), 6) AS amount_std, round(stddev_samp(hour), 6) AS hour_std FROM t""")
def _feature_stats(spark, folder):
    return scoring.feature_stats(_training_set(spark, folder))


_SCORED = f"""WITH {_DOMAIN},
scored AS (
  SELECT who AS "cardId", value AS amount, ts AS event_time,
    1 / (1 + exp(-(-3.0 + 4.0 * (value - 50) / 50
                   + 0.25 * (hour(make_timestamp(ts * 1000)) - 11.5) / 7.0))) AS score
  FROM dom WHERE type = 'TXN')
SELECT "cardId", round(amount, 6) AS amount, event_time, round(coalesce(score, 0.0), 6) AS score,
       coalesce(score, 0.0) > 0.85 AS decision FROM scored"""


@_query("score_decision", _SCORED)
def _score_decision(spark, folder):
    return scoring.decide(scoring.score(_features(_source(spark, folder))[0], MODEL))


@_query("train_fraud_model", f"""WITH {_DOMAIN}
SELECT count(*) AS n, count(*) FILTER (value > 120) AS positives, TRUE AS accurate FROM dom
WHERE type = 'TXN' AND value IS NOT NULL AND seq % 100 >= 80""")
def _train_fraud_model(spark, folder):
    labelled = scoring.training_set(adapters.auth_txn(_source(spark, folder)), keep=("seq",))
    train, test = scoring.split(labelled, by=F.col("seq"))
    found = scoring.evaluate(test, scoring.train(train))
    return found.select("n", "positives", (F.col("accuracy") > 0.95).alias("accurate"))


@_query("score_stream", f"""WITH {_DOMAIN}
SELECT who AS "cardId", round(value, 6) AS amount, ts AS event_time, TRUE AS in_range, TRUE AS rises FROM dom
WHERE type = 'TXN'""")
def _score_stream(spark, folder):
    """Scores by a trained model, with what must hold for them: from 0 to 1, 0 without an amount, more for more."""
    model = scoring.train(_training_set(spark, folder))
    scored = scoring.score(_features(_stream(spark, folder))[0], model).withColumnRenamed("score", "now")
    more = scoring.score(scored.withColumnsRenamed({"amount": "paid"}).withColumn("amount", F.col("paid") + 1), model)
    checked = more.select(
        "cardId", F.col("paid").alias("amount"), "event_time",
        (F.col("now").between(0, 1) & (F.col("paid").isNotNull() | (F.col("now") == 0))).alias("in_range"),
        (F.col("score") >= F.col("now")).alias("rises"),
    )
    return _drained(checked, "score-stream")


@_query("scored_sink", _SCORED)
def _scored_sink(spark, folder):
    scored = scoring.decide(scoring.score(_features(_stream(spark, folder))[0], MODEL))
    return _drained(scored, "scored")


LATER_MODEL = scoring.LinearModel((2.0, -0.5), -1.0, (40.0, 12.0), (30.0, 6.0))
LATER_FROM = "2024-01-15 12:00:00"


@_query("score_by_version", f"""WITH {_DOMAIN},
scored AS (
  SELECT who AS "cardId", value AS amount, ts AS event_time, hour(make_timestamp(ts * 1000)) AS h,
         CASE WHEN ts >= epoch_ms(TIMESTAMP '{LATER_FROM}') THEN 2 WHEN ts >= epoch_ms(TIMESTAMP '2024-01-02 00:00:00') THEN 1 END AS version
  FROM dom WHERE type = 'TXN'),
judged AS (
  SELECT *, coalesce(CASE version
      WHEN 1 THEN 1 / (1 + exp(-(-3.0 + 4.0 * (amount - 50) / 50 + 0.25 * (h - 11.5) / 7.0)))
      WHEN 2 THEN 1 / (1 + exp(-(-1.0 + 2.0 * (amount - 40) / 30 - 0.5 * (h - 12.0) / 6.0))) END, 0.0) AS score FROM scored)
SELECT "cardId", round(amount, 6) AS amount, event_time, CAST(version AS BIGINT) AS version, round(score, 6) AS score,
       score > 0.85 AS decision FROM judged""")
def _score_by_version(spark, folder):
    models = _published(spark)
    return scoring.decide(model_versions.score_by_version(_features(_source(spark, folder))[0], model_versions.versions(spark, models)))


def _published(spark):
    path = scratch_path(spark, "models")
    model_versions.publish(spark, path, 2, LATER_FROM, LATER_MODEL)
    model_versions.publish(spark, path, 1, "2024-01-02 00:00:00", MODEL)
    return path


@_query("score_by_version_stream", _SQL["score_by_version"])
def _score_by_version_stream(spark, folder):
    path, payments = scratch_path(spark, "scored-by-version"), _features(_stream(spark, folder))[0]
    score_stream_by_version(payments, _published(spark), path, scratch_path(spark, "scored-by-version-checkpoint")).awaitTermination()
    kinds = [f"{field.name} {field.dataType.simpleString()}" for field in payments.schema]
    return upserts.written(spark, path, ", ".join([*kinds, "version long", "score double", "decision boolean"]))


# --- streams ----------------------------------------------------------------------------------------
# Each has the SQL of its batch twin: a replay ends with rows that make the stream emit all of its results.


def _twin(name: str):
    return _query(f"{name}_stream", _SQL[name])


@_twin("small_then_large")
def _pair_stream(spark, folder):
    events = adapters.auth_txn(_replay(spark, folder))
    return _replayed(match_sequence_stream(events, PAIR, LATE), "pair", folder)


@_twin("insider_exfil")
def _triple_stream(spark, folder):
    events = adapters.insider_events(_replay(spark, folder))
    return _replayed(match_sequence_stream(events, TRIPLE, LATE), "triple", folder)


@_twin("followed_by")
def _followed_by_stream(spark, folder):
    events = adapters.all_activity(_replay(spark, folder))
    return _replayed(match_sequence_stream(events, PAIR_WITH_SKIPS, LATE), "followed-by", folder)


@_twin("sequence_timeouts")
def _sequence_timeouts_stream(spark, folder):
    events = adapters.insider_events(_replay(spark, folder))
    outcomes = _replayed(sequence_outcomes_stream(events, TRIPLE, LATE), "timeouts", folder)
    return outcomes.where("waited_for IS NOT NULL")


@_twin("followed_by_timeouts")
def _followed_by_timeouts_stream(spark, folder):
    events = adapters.all_activity(_replay(spark, folder))
    outcomes = _replayed(sequence_outcomes_stream(events, PAIR_WITH_SKIPS, LATE), "followed-by-timeouts", folder)
    return outcomes.where("waited_for IS NOT NULL")


@_twin("gold_alert_dashboard")
def _dashboard_stream(spark, folder):
    return _replayed(gold.alert_dashboard(_silver_alerts(_replay(spark, folder))), "dashboard", folder)


@_twin("gold_daily_alert_summary")
def _daily_stream(spark, folder):
    return _replayed(gold.daily_alert_summary(_silver_alerts(_replay(spark, folder))), "daily", folder)


@_twin("gold_alert_patterns")
def _patterns_stream(spark, folder):
    return _replayed(gold.alert_patterns(_silver_alerts(_replay(spark, folder))), "patterns", folder)


@_twin("gold_alert_pattern_entities")
def _pattern_entities_stream(spark, folder):
    return _replayed(gold.pattern_entities(_silver_alerts(_replay(spark, folder))), "entities", folder)


@_twin("gold_executive_dashboard")
def _executive_stream(spark, folder):
    return _replayed(gold.executive_dashboard(_silver_alerts(_replay(spark, folder))), "executive", folder)


@_twin("alerts_join_txn")
def _join_stream(spark, folder):
    source = _replay(spark, folder)
    joined = combined.stream_alerts_with_payments(_silver_alerts(source), _features(source)[0], LATE)
    return _replayed(joined.select("id", "rule", "ts", "cardId", "amount", "txn_time"), "join", folder)


@_twin("alerts_join_insider")
def _join_insider_stream(spark, folder):
    source = _replay(spark, folder)
    joined = combined.stream_alerts_with_activity(_silver_alerts(source), _features(source)[1], LATE)
    return _replayed(joined.select("id", "rule", "ts", "actor", "type", "insider_time"), "join-insider", folder)


def _joined_by_batch(spark, folder, number, join, name):
    """The alert stream joined, batch by batch, with the period of a feature table that it can reach."""
    source, path = _source(spark, folder), scratch_path(spark, name)
    combined.join_by_batch(
        _silver_alerts(_stream(spark, folder)), lambda first, last: _features(adapters.between(source, first, last))[number],
        join, path, scratch_path(spark, f"{name}-checkpoint"),
    ).awaitTermination()
    return spark.read.parquet(path)


@_query("alerts_join_txn_static", _SQL["alerts_join_txn"])
def _join_static(spark, folder):
    joined = _joined_by_batch(spark, folder, 0, gold.alerts_with_payments, "join-static")
    return joined.select("id", "rule", "ts", "cardId", "amount", "txn_time")


@_query("alerts_join_insider_static", _SQL["alerts_join_insider"])
def _join_insider_static(spark, folder):
    joined = _joined_by_batch(spark, folder, 1, gold.alerts_with_activity, "insider-static")
    return joined.select("id", "rule", "ts", "actor", "type", "insider_time")


@_twin("gold_combined_threat")
def _combined_stream(spark, folder):
    source = _replay(spark, folder)
    table = combined.stream_combined_threat_analytics(_silver_alerts(source), *_features(source), delay=LATE)
    return _replayed(table, "combined", folder)


# --- estimated distinct counts ----------------------------------------------------------------------
# Shown as whether they lie within 5 % (or 1) of the exact ones, which hold for every row.


def _close(estimated: DataFrame, exact: DataFrame, keys: list[str], count: str) -> DataFrame:
    exact = exact.select(*keys, F.col(count).alias("exactly"))
    off = F.abs(F.col(count) - F.col("exactly"))
    joined = estimated.join(exact, keys, "left").withColumn("unique_close", F.coalesce(off <= F.greatest(F.lit(1), F.col("exactly") * 0.05), F.lit(False)))
    return joined.drop(count, "exactly")


_DASHBOARD_KEYS = ["window_start", "alert_type", "severity"]
_DAILY_KEYS = ["date", "alert_type", "alert_category", "severity"]


@_query("gold_alert_dashboard_approx", f"WITH {_DASHBOARD} SELECT * EXCLUDE (unique_entities), TRUE AS unique_close FROM dashboard")
def _dashboard_approx(spark, folder):
    return _close(gold.alert_dashboard(_silver(spark, folder), distinct="approx"), _dashboard(spark, folder), _DASHBOARD_KEYS, "unique_entities")


@_query("gold_daily_alert_summary_approx", f"WITH {_DAILY} SELECT * EXCLUDE (unique_entities_affected), TRUE AS unique_close FROM daily")
def _daily_approx(spark, folder):
    estimated = gold.daily_alert_summary(_silver(spark, folder), distinct="approx")
    return _close(estimated, _daily(spark, folder), _DAILY_KEYS, "unique_entities_affected")


@_query("gold_daily_rolled_up", f"""WITH {_DAILY}
SELECT date, alert_type, alert_category, severity, total_alerts, TRUE AS unique_close FROM daily""")
def _daily_rolled_up(spark, folder):
    days = gold.daily_entities(gold.entity_sketches(_silver(spark, folder)))
    return _close(days, _daily(spark, folder), _DAILY_KEYS, "unique_entities_affected")


@_twin("gold_alert_dashboard_approx")
def _dashboard_approx_stream(spark, folder):
    found = _replayed(gold.alert_dashboard(_silver_alerts(_replay(spark, folder)), distinct="approx"), "dashboard-approx", folder)
    return _close(found, _dashboard(spark, folder), _DASHBOARD_KEYS, "unique_entities")


@_twin("gold_daily_alert_summary_approx")
def _daily_approx_stream(spark, folder):
    found = _replayed(gold.daily_alert_summary(_silver_alerts(_replay(spark, folder)), distinct="approx"), "daily-approx", folder)
    return _close(found, _daily(spark, folder), _DAILY_KEYS, "unique_entities_affected")


@_query("gold_alert_dashboard_update", _SQL["gold_alert_dashboard_approx"])
def _dashboard_update(spark, folder):
    """The dashboard as a table kept up to date by a stream in update mode."""
    table, path = gold.alert_dashboard(_silver_alerts(_replay(spark, folder)), distinct="approx"), scratch_path(spark, "upserts")
    upserts.upsert_stream(table, path, scratch_path(spark, "upserts-checkpoint")).awaitTermination()
    found = adapters.without_flush(upserts.current(spark, path, _DASHBOARD_KEYS, table.schema), _source(spark, folder))
    return _close(found, _dashboard(spark, folder), _DASHBOARD_KEYS, "unique_entities")


# --- gold by increments -----------------------------------------------------------------------------


def _by_increments(spark, folder, name):
    """A gold table after three batches: the events up to a day, those after it, and some of all days that come late."""
    store, source = incremental.DailyGold(scratch_path(spark, "daily-gold")), _source(spark, folder)
    late, early = F.col("event_id") % 37 == 0, F.coalesce(F.col("ts") < F.lit("2024-01-15 12:00:00").cast("timestamp"), F.lit(True))
    for batch, some in (("early", ~late & early), ("rest", ~late & ~early), ("late", late)):
        part = source.where(some)
        store.add(batch, _silver_alerts(part), *_features(part), tables=[name])
    return store.read(spark, name)


for _name, _of in [(name, name.removesuffix("_analytics")) for name in incremental.TABLES]:
    _query(f"{_of}_incremental", _SQL[_of])(lambda spark, folder, name=_name: _by_increments(spark, folder, name))


# --- queries of the training-data operators, where that subpackage and all it needs are present ------


def _optional(module: str):
    """The module, or None (with a warning, unless it was simply left out) where it can't be imported."""
    try:
        return importlib.import_module(module)
    except ImportError as error:
        if getattr(error, "name", None) not in ("wardline.llm", "corpus_pipeline"):
            warnings.warn(f"{module} is not registered: {error}", stacklevel=2)
        return None


if _llm := _optional("wardline.llm.queries"):
    _QUERIES.update(_llm.QUERIES)
    _SQL.update(_llm.SQL)

if _pipeline := _optional("corpus_pipeline"):
    _QUERIES["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL:
        _SQL["pipeline"] = _pipeline.ORACLE_SQL
