import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import T
from wardline.operators.decode import broken_values, decode_alerts, decode_events, encode_alerts
from wardline.operators.quality import ALERT_RULES, EVENT_RULES, expect, violation_counts
from wardline.plans import events as plans

RAW = [
    '{"type":"TXN","cardId":1234,"amount":"12.5","ts":"5"}',
    '{"type":"TXN"}',
    '{"type":"TXN","cardId":"c","amount":3,"ts":1.5}',
    "{bad",
    '{"type":null,"actor":"u","ts":9007199254740993}',
    "",
    "[1]",
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(list(enumerate(RAW)), "seq long, value string")


def rows(frame):
    return [tuple(r) for r in frame.orderBy("seq").collect()]


def test_strict(raw):
    got = decode_events(raw, "strict", default_ts=F.lit(42).cast("long"))
    assert rows(got) == [
        (0, "TXN", "1234", 12.5, "", 5),
        (1, "TXN", "", 0.0, "", 42),
        (2, "TXN", "c", 3.0, "", 1),
        (4, "", "", 0.0, "u", 9007199254740993),
        (5, "", "", 0.0, "", 42),
        (6, "", "", 0.0, "", 42),
    ]


@pytest.mark.parametrize("text, expected", [
    ('{"type":{"a":1},"cardId":["x"],"amount":true}', ("", "", 1.0)),
    ('{"type":"{\\"a\\":1}","cardId":"[x]","amount":"true"}', ('{"a":1}', "[x]", 0.0)),
    ('{"type":true,"cardId":{},"amount":false}', ("true", "", 0.0)),
    ('{"type":"TXN","cardId":"{","amount":{"v":1}}', ("TXN", "{", 0.0)),
])
def test_strict_values_of_other_kinds(spark, text, expected):
    row = decode_events(spark.createDataFrame([(text,)], "value string"), "strict").head()
    assert (row.type, row.cardId, row.amount) == expected


def test_broken_values_are_set_aside(raw):
    assert rows(broken_values(raw)) == [(3, "{bad")]


def test_missing_time_is_now(raw):
    assert decode_events(raw).where("seq = 1").head().ts > T


def test_lenient(raw):
    assert rows(decode_events(raw, "lenient"))[:4] == [
        (0, "TXN", "1234", None, None, None),
        (1, "TXN", None, None, None, None),
        (2, "TXN", "c", 3.0, None, None),
        (3, None, None, None, None, None),
    ]


def test_unknown_mode(raw):
    with pytest.raises(ValueError):
        decode_events(raw, "other")


def test_alerts_there_and_back(spark):
    alerts = spark.createDataFrame([('a"b', "R", T), ("c", None, 1)], "id string, rule string, ts long")
    encoded = encode_alerts(alerts)
    assert json.loads(encoded.head().value) == {"id": 'a"b', "rule": "R", "ts": T}
    back = decode_alerts(encoded.select("value"))
    assert back.exceptAll(alerts).isEmpty() and back.count() == 2


def test_expectations_drop_and_count(raw):
    decoded = decode_events(raw, "lenient")
    seen = Observation("quality")
    kept = expect(decoded, EVENT_RULES, seen)
    assert {r.type for r in kept.collect()} == {"TXN"}
    assert seen.get == {"rows": 7, "has_ts": 6, "valid_type": 4}


def test_violation_counts(raw, spark):
    counted = violation_counts(decode_events(raw, "lenient"), EVENT_RULES, missing_key="cardId")
    assert sorted(tuple(r) for r in counted.collect()) == [
        ("has_cardId", "keep", 7, 5), ("has_ts", "keep", 7, 6), ("valid_type", "drop", 7, 4)]
    alerts = spark.createDataFrame([("a", "R"), (None, "R"), ("a", None)], "id string, rule string")
    assert violation_counts(alerts, ALERT_RULES).head().violations == 2


def test_event_tables(spark):
    lines = [
        f'{{"type":"TXN","cardId":"c","amount":3.5,"ts":{T}}}',
        f'{{"type":"BULK_EXPORT","actor":"u","ts":{T + 1}}}',
        f'{{"type":"REFUND","cardId":"c","ts":{T}}}',
        "{bad",
    ]
    raw = spark.createDataFrame([(line,) for line in lines], "value string")
    silver = plans.silver_events(plans.bronze_events(raw))
    assert silver.count() == 2
    fraud, insider = plans.features_fraud(silver), plans.features_insider(silver)
    assert [tuple(r) for r in fraud.selectExpr("cardId", "amount", "unix_millis(event_time)").collect()] == [("c", 3.5, T)]
    assert [tuple(r) for r in insider.selectExpr("actor", "type", "unix_millis(event_time)").collect()] == [
        ("u", "BULK_EXPORT", T + 1)]
    assert fraud.columns == ["cardId", "amount", "event_time"]
    assert insider.columns == ["actor", "type", "event_time"]
