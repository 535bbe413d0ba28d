import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, T
from wardline.operators.decode import with_event_time
from wardline.plans import alerts as alert_plans
from wardline.plans import events as event_plans
from wardline.plans import gold, reports
from wardline.sources import adapters

STL, EXFIL, OTHER = "SMALL_THEN_LARGE", "INSIDER_EXFIL", "FRAUD_OTHER"
HOUR = 3_600_000


@pytest.fixture
def silver(spark):
    def build(rows):
        frame = spark.createDataFrame(rows, "id string, rule string, ts long")
        return alert_plans.silver_alerts(with_event_time(frame))

    return build


@pytest.fixture
def payments(spark):
    def build(rows):
        frame = spark.createDataFrame(rows, "cardId string, amount double, ts long")
        return frame.select("cardId", "amount", F.timestamp_millis("ts").alias("event_time"))

    return build


@pytest.fixture
def activity(spark):
    def build(rows):
        frame = spark.createDataFrame(rows, "actor string, type string, ts long")
        return frame.select("actor", "type", F.timestamp_millis("ts").alias("event_time"))

    return build


def test_enrichment(silver):
    rows = silver([("a", STL, T), ("b", EXFIL, T), ("c", OTHER, T), ("d", None, T)])
    got = {r.id: (r.alert_type, r.severity, r.alert_category, r.business_impact) for r in rows.collect()}
    assert got == {
        "a": ("FRAUD_TRANSACTION", "HIGH", "Security Event", "Medium - Investigation Needed"),
        "b": ("INSIDER_THREAT", "CRITICAL", "Insider Threat", "High - Immediate Response Required"),
        "c": ("UNKNOWN", "MEDIUM", "Financial Fraud", "Low - Monitor"),
        "d": ("UNKNOWN", "MEDIUM", "Security Event", "Low - Monitor"),
    }
    first = rows.head()
    assert (first.year, first.month, first.day, first.hour) == (2024, 1, 1, 0)


def test_bronze_alerts_keep_what_they_count(spark):
    raw = spark.createDataFrame([('{"id":"a","rule":"R","ts":1500}', 7), ("{bad", 8)], "value string, offset long")
    got = alert_plans.bronze_alerts(raw).orderBy("offset").collect()
    assert [(r.offset, r.id, r.rule, r.ts) for r in got] == [(7, "a", "R", 1500), (8, None, None, None)]
    assert got[0].ingestion_ts is not None


def test_dashboard_windows(silver):
    rows = gold.alert_dashboard(silver([("a", STL, T), ("a", STL, T + 299999), ("b", STL, T + 300000)]))
    got = [tuple(r) for r in rows.selectExpr(
        "unix_millis(window_start)", "alert_count", "unique_entities", "alerts_per_minute",
        "severity_score", "risk_score").orderBy("window_start").collect()]
    assert got == [(T, 2, 1, 0.4, 7, 14), (T + 300000, 1, 1, 0.2, 7, 7)]


@pytest.mark.parametrize("count,label,spike", [
    (5, "NORMAL", False), (6, "MODERATE_SPIKE", True), (10, "MODERATE_SPIKE", True), (11, "HIGH_SPIKE", True)])
def test_pattern_intensity(silver, count, label, spike):
    rows = gold.alert_patterns(silver([(f"e{i % 3}", STL, T + 100 * i) for i in range(count)])).collect()
    assert len(rows) == 2  # every alert lies in two sliding windows
    assert {(r.pattern_count, r.unique_victims, r.pattern_intensity, r.is_spike) for r in rows} == {
        (count, 3, label, spike)}
    assert {(r.pattern_date, r.pattern_hour) for r in rows} == {("2023-12-31", 23), ("2024-01-01", 0)}


def test_pattern_thresholds_are_arguments(silver):
    row = gold.alert_patterns(silver([("a", STL, T)]), spike_above=0, intensity=[(0, "ANY")]).head()
    assert (row.is_spike, row.pattern_intensity) == (True, "ANY")


def test_pattern_entities(silver):
    alerts = silver([("b", STL, T), ("a", STL, T + 1), ("b", STL, T + 2)])
    entities = gold.pattern_entities(alerts)
    assert {(r.entity, r.alerts) for r in entities.collect()} == {("a", 1), ("b", 2)}


def test_daily_summary(silver):
    rows = gold.daily_alert_summary(silver([("a", STL, T), ("b", STL, T + HOUR), ("a", STL, T + 2 * HOUR)]))
    row = rows.head()
    assert (row.date, row.total_alerts, row.unique_entities_affected, row.rules_triggered) == ("2024-01-01", 3, 2, [STL])
    assert (row.alerts_per_hour, row.severity_weight, row.weighted_risk_score) == (0.125, 2, 6)
    assert (row.last_alert_time - row.first_alert_time).total_seconds() == 7200


def test_rules_of_one_group_are_merged(silver):
    rows = silver([("a", "X_FRAUD", T), ("a", "Y_FRAUD", T), ("b", "X_FRAUD", T), ("c", "Z_FRAUD", T)])
    row = gold.daily_alert_summary(rows).head()
    assert (row.rules_triggered, row.total_alerts, row.unique_entities_affected) == (
        ["X_FRAUD", "Y_FRAUD", "Z_FRAUD"], 4, 3)


def test_alerts_without_time_form_a_day(silver):
    rows = silver([("a", STL, T), (None, None, None)])
    assert {r.date for r in gold.daily_alert_summary(rows).collect()} == {"2024-01-01", None}
    assert {(r.date, r.total_alerts, r.unique_entities) for r in gold.executive_dashboard(rows).collect()} == {
        ("2024-01-01", 1, 1), (None, 1, 0)}


@pytest.mark.parametrize("rules,index,trend", [
    ([OTHER], 1.0, "🟢 LOW RISK"), ([STL], 2.0, "🟡 MEDIUM RISK"), ([EXFIL], 3.0, "🔴 HIGH RISK"),
    ([OTHER, STL], 1.5, "🟡 MEDIUM RISK"), ([EXFIL, STL], 2.5, "🔴 HIGH RISK")])
def test_threat_trend(silver, rules, index, trend):
    row = gold.executive_dashboard(silver([("a", rule, T) for rule in rules])).head()
    assert (row.risk_index, row.threat_trend) == (index, trend)
    assert (row.alert_duration_hours, row.alerts_per_hour) == (0.0, None)


def test_executive_figures(silver):
    row = gold.executive_dashboard(silver([("a", STL, T), ("b", EXFIL, T + HOUR), ("a", OTHER, T + 2 * HOUR), ("c", EXFIL, T)])).head()
    assert (row.total_alerts, row.unique_entities, row.critical_alerts, row.high_alerts, row.medium_alerts) == (4, 3, 2, 1, 1)
    assert (row.fraud_alerts, row.insider_alerts, row.alert_duration_hours, row.alerts_per_hour) == (1, 2, 2.0, 2.0)
    assert (row.critical_percentage, row.fraud_percentage, row.insider_percentage) == (50.0, 25.0, 50.0)


def literal_combined(alerts, fraud, insider):
    """The table from the joined rows themselves."""
    joined = gold.alerts_with_activity(gold.alerts_with_payments(alerts, fraud), insider)
    return joined.groupBy(F.date_format("event_time", "yyyy-MM-dd").alias("date"), "alert_type", "severity").agg(
        F.count("*").alias("alert_count"),
        F.countDistinct("cardId").alias("cards_involved"),
        F.countDistinct("actor").alias("actors_involved"),
        F.sum("amount").alias("total_amount_affected"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.sort_array(F.collect_set("rule")).alias("active_rules"),
        F.sort_array(F.collect_set("type")).alias("event_types"),
    )


def same_as_literal(alerts, fraud, insider):
    """Equal up to the order in which amounts were added."""
    literal = literal_combined(alerts, fraud, insider)
    ours = gold.combined_threat_analytics(alerts, fraud, insider).select(literal.columns)

    def by_group(frame):
        return {(r.date, r.alert_type, r.severity): tuple(
            pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for v in r) for r in frame.collect()}

    return by_group(literal) == {k: tuple(r) for k, r in
                                 ((tuple(r)[:3], r) for r in ours.collect())}


def test_combined_fixture(silver, payments, activity):
    alerts = silver([("c1", STL, T + 100_000), ("u1", EXFIL, T + 200_000), ("zz", STL, T + 300_000)])
    fraud = payments([("c1", 3.0, T + 50_000), ("c1", 700.0, T + 99_000), ("c1", 9.0, T + 9_000_000)])
    insider = activity([("u1", "PRIV_ESC", T + 150_000), ("u1", "EXT_SHARE", T + 190_000)])
    got = {r.alert_type: r for r in gold.combined_threat_analytics(alerts, fraud, insider).collect()}
    row = got["INSIDER_THREAT"]
    assert (row.alert_count, row.total_amount_affected, row.cards_involved, row.actors_involved) == (2, None, 0, 1)
    assert (row.financial_impact_score, row.event_types, row.threat_level) == (0.0, ["EXT_SHARE", "PRIV_ESC"], "LOW")
    row = got["FRAUD_TRANSACTION"]
    assert (row.alert_count, row.total_amount_affected, row.cards_involved, row.actors_involved) == (3, 703.0, 1, 0)
    assert (row.avg_transaction_amount, row.event_types, row.threat_level) == (351.5, [], "MODERATE")


@pytest.mark.parametrize("offset,partners", [
    (3_599_000, 1), (3_599_999, 1), (3_600_000, 0), (-3_599_000, 1), (-3_600_000, 0), (-3_599_001, 0)])
def test_band_is_in_whole_seconds(silver, payments, offset, partners):
    alerts, fraud = silver([("a", STL, T)]), payments([("a", 1.0, T + offset)])
    joined = gold.alerts_with_payments(alerts, fraud)
    assert joined.count() == 1
    assert joined.where("cardId IS NOT NULL").count() == partners
    row = gold.combined_threat_analytics(alerts, fraud, fraud.selectExpr("cardId AS actor", "'PRIV_ESC' AS type", "event_time")).head()
    assert (row.cards_involved, row.actors_involved) == (partners, partners)


@pytest.mark.parametrize("count,rule,level", [
    (2, EXFIL, "LOW"), (3, EXFIL, "MODERATE"), (6, EXFIL, "HIGH"), (11, EXFIL, "SEVERE"),
    (6, STL, "HIGH"), (11, STL, "HIGH"), (11, OTHER, "MODERATE")])
def test_threat_level(silver, payments, activity, count, rule, level):
    alerts = silver([(f"e{i}", rule, T) for i in range(count)])
    row = gold.combined_threat_analytics(alerts, payments([]), activity([])).head()
    assert (row.alert_count, row.threat_level) == (count, level)


def test_combined_equals_joined_rows(spark):
    source = adapters.read_table(spark, SMALL)
    events = adapters.domain_events(source)
    alerts = alert_plans.silver_alerts(with_event_time(adapters.alert_feed(source)))
    assert same_as_literal(alerts, event_plans.features_fraud(events), event_plans.features_insider(events))


def test_combined_with_missing_values_and_one_dense_key(spark, silver, payments, activity):
    """A key that holds most rows, repeated seconds, missing ids and amounts."""
    ids = ["hot", "hot", "hot", "b", None]
    alerts = silver([(ids[i % 5], [STL, EXFIL, OTHER][i % 3], T + (i * 337_000) % (40 * HOUR)) for i in range(120)]
                    + [("hot", STL, T)] * 3)
    fraud = payments([(ids[i % 4], None if i % 7 == 0 else float(i), T + (i * 911_000) % (40 * HOUR)) for i in range(90)]
                     + [("hot", 2.5, T + 10)] * 4 + [("n", None, T)])
    insider = activity([(ids[i % 5], ["PRIV_ESC", "EXT_SHARE"][i % 2], T + (i * 577_000) % (40 * HOUR)) for i in range(80)])
    assert same_as_literal(alerts, fraud, insider)


@pytest.mark.parametrize("far", [1e9, 1e17, -1e17, float("nan"), float("inf")])
def test_amounts_outside_the_band_leave_no_trace(silver, payments, activity, far):
    alerts = silver([("a", STL, T + 2 * HOUR)])
    fraud = payments([("a", far, T + at) for at in (0, HOUR // 2, 4 * HOUR)] + [("a", 0.1, T + 2 * HOUR)])
    row = gold.combined_threat_analytics(alerts, fraud, activity([])).head()
    assert (row.alert_count, row.total_amount_affected, row.avg_transaction_amount) == (1, 0.1, 0.1)


def test_any_type_of_activity_counts(silver, payments, activity):
    alerts, insider = silver([("a", STL, T)]), activity([("a", "LOGIN", T), ("a", "PRIV_ESC", T + 1), ("a", "LOGIN", T + 2)])
    row = gold.combined_threat_analytics(alerts, payments([]), insider).head()
    assert (row.alert_count, row.actors_involved, row.event_types) == (3, 1, ["LOGIN", "PRIV_ESC"])
    assert same_as_literal(alerts, payments([]), insider)


@pytest.mark.parametrize("seed", range(3))
def test_combined_equals_joined_rows_at_random(silver, payments, activity, seed):
    draw = random.Random(seed)

    def at():
        return T + draw.choice([0, 1, 3599, 3600, 7198, 7199, 7200, 14398]) * 1000 + draw.randint(0, 8) * 1000

    alerts = silver([(draw.choice("ab"), draw.choice([STL, EXFIL]), at()) for _ in range(40)])
    fraud = payments([(draw.choice("ab"), draw.choice([1.5, 2.25, None]), at()) for _ in range(40)])
    insider = activity([(draw.choice("ab"), draw.choice(["PRIV_ESC", "EXT_SHARE", "X"]), at()) for _ in range(30)])
    assert same_as_literal(alerts, fraud, insider)


def test_combined_shuffles_four_times(spark):
    source = adapters.read_table(spark, SMALL)
    events = adapters.domain_events(source)
    alerts = alert_plans.silver_alerts(with_event_time(adapters.alert_feed(source)))
    table = gold.combined_threat_analytics(alerts, event_plans.features_fraud(events), event_plans.features_insider(events))
    plan = table._jdf.queryExecution().toString()
    assert plan[plan.index("== Physical Plan =="):].count("Exchange hashpartitioning") <= 4


AS_OF = "2024-01-10 10:20:00"


def test_dashboard_reports(silver):
    at = T + 9 * 24 * HOUR + 9 * HOUR  # 2024-01-10 09:00
    table = gold.alert_dashboard(silver([("a", STL, at), ("a", STL, at + 20 * 60_000), ("a", STL, at + HOUR), ("b", EXFIL, at + HOUR)]))
    last = reports.dashboard_last_hour(table, AS_OF).collect()
    assert [r.window_start.strftime("%H:%M") for r in last] == ["10:00", "10:00", "09:20"]
    now = reports.current_hour(table, AS_OF).collect()
    assert sorted((r.time_window, r.alert_type, r.total_alerts, r.avg_risk_score) for r in now) == [
        ("10:00", "FRAUD_TRANSACTION", 1, 7.0), ("10:00", "INSIDER_THREAT", 1, 10.0)]


def test_daily_reports(silver):
    days = [T + d * 24 * HOUR for d in (1, 2, 9)]
    alerts = silver([("a", STL, at) for at in days] + [("a", EXFIL, days[2])])
    assert [(r.date, r.weighted_risk_score) for r in reports.daily_summary_week(gold.daily_alert_summary(alerts), AS_OF).collect()] == [
        ("2024-01-10", 3), ("2024-01-10", 2), ("2024-01-03", 2)]
    executive = gold.executive_dashboard(alerts)
    assert [r.date for r in reports.executive_month(executive, AS_OF).collect()] == ["2024-01-10", "2024-01-03", "2024-01-02"]
    trend = reports.risk_trend_week(executive, AS_OF).collect()
    assert [(r.date, r.critical_pct, r.risk_index) for r in trend] == [("2024-01-10", 50.0, 2.5), ("2024-01-03", 0.0, 2.0)]


def test_pattern_reports(silver):
    at = T + 9 * 24 * HOUR
    patterns = gold.alert_patterns(silver([("a", STL, at + i) for i in range(11)] + [("a", EXFIL, at + i) for i in range(6)] + [("b", OTHER, at)]))
    assert [r.pattern_count for r in reports.spikes(patterns).collect()] == [11, 11, 6, 6]
    top = {r.rule: (r.occurrences, r.active_days, r.avg_daily_alerts, r.peak_alerts) for r in reports.top_patterns_week(patterns, AS_OF).collect()}
    assert top == {STL: (2, 2, 11.0, 11), EXFIL: (2, 2, 6.0, 6)}


def test_fraud_vs_insider(silver, payments, activity):
    alerts = silver([("a", STL, T), ("a", STL, T + 60_000), ("u", EXFIL, T)])
    table = gold.combined_threat_analytics(alerts, payments([("a", 1.255, T)]), activity([("u", "PRIV_ESC", T)]))
    got = [(r.date, r.alert_type, r.alerts, r.cards_affected, r.actors_involved, r.total_amount, r.threat_level)
           for r in reports.fraud_vs_insider_month(table, AS_OF).collect()]
    assert got == [("2024-01-01", "FRAUD_TRANSACTION", 2, 1, 0, 2.51, "LOW"),
                   ("2024-01-01", "INSIDER_THREAT", 1, 0, 1, None, "LOW")]
