"""Streams against the batch operators: out-of-order files, late rows, restarts, sentinels."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import T
from wardline.operators.decode import decode_events, with_event_time
from wardline.operators.sequence import insider_exfil, match_sequence, small_then_large
from wardline.plans import alerts as alert_plans
from wardline.plans import gold
from wardline.schemas import ALERT, EVENT
from wardline.streaming.combined import (
    join_by_batch, stream_alerts_with_activity, stream_alerts_with_payments, stream_combined_threat_analytics,
)
from wardline.streaming.runs import drain, write_stream
from wardline.streaming.sequence import match_sequence_stream

DAY = 86_400_000
EVENTS = "seq long, cardId string, type string, amount double, ts long"


def write_files(folder, chunks, start=0):
    """One JSON file per chunk, with increasing modification times."""
    import os

    folder.mkdir(exist_ok=True)
    for i, chunk in enumerate(chunks, start):
        path = folder / f"part-{i:04}.json"
        path.write_text("".join(json.dumps(row) + "\n" for row in chunk))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def read_stream(spark, folder, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(str(folder))


def event(seq, key, kind, amount, ts):
    return {"seq": seq, "cardId": key, "type": kind, "amount": amount, "ts": ts}


def as_events(frame):
    return frame.selectExpr("*", "cardId AS actor", "timestamp_millis(ts) AS event_time")


def random_events(n, keys, seed):
    draw = random.Random(seed)
    kinds = ["TXN", "TXN", "TXN", "PRIV_ESC", "BULK_EXPORT", "EXT_SHARE"]
    return [
        event(i, f"k{draw.randrange(keys)}", draw.choice(kinds), draw.choice([1.0, 50.0, 900.0]),
              T + i * 1000 + draw.randrange(500))
        for i in range(n)
    ]


def shuffled_chunks(rows, size, block, seed):
    draw = random.Random(seed)
    out = []
    for i in range(0, len(rows), block):
        part = rows[i:i + block]
        draw.shuffle(part)
        out += part
    return [out[i:i + size] for i in range(0, len(out), size)]


SENTINEL = event(10**6, "sentinel", "TXN", 50.0, T + 10 * DAY)
RULES = {
    "pair": small_then_large(within="20 seconds"),
    "pair, skipping": small_then_large(within="20 seconds", skip=True),
    "triple": insider_exfil("40 seconds"),
}


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("spans", [1, 8])
def test_stream_equals_batch(spark, tmp_path, rule, spans):
    rows = random_events(600, 3, seed=spans)
    write_files(tmp_path / "in", [*shuffled_chunks(rows, 150, 20, seed=1), [SENTINEL]])
    expected = match_sequence(as_events(spark.createDataFrame([tuple(r.values()) for r in rows], EVENTS)), RULES[rule])
    stream = as_events(read_stream(spark, tmp_path / "in", EVENTS))
    found = drain(
        match_sequence_stream(stream, RULES[rule], "1 minute", bucket_spans=spans),
        str(tmp_path / "out"), str(tmp_path / "chk"))
    assert not expected.isEmpty()
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_late_row_is_dropped(spark, tmp_path):
    """A row behind the watermark neither matches nor breaks a match."""
    chunks = [
        [event(1, "a", "TXN", 1.0, T), event(3, "a", "TXN", 900.0, T + 10_000)],
        [event(4, "z", "TXN", 50.0, T + DAY)],
        [event(6, "z", "TXN", 50.0, T + DAY)],
        [event(2, "a", "TXN", 50.0, T + 5_000), event(5, "z", "TXN", 50.0, T + DAY + 1)],
        [SENTINEL],
    ]
    write_files(tmp_path / "in", chunks)
    stream = as_events(read_stream(spark, tmp_path / "in", EVENTS))
    query = write_stream(
        match_sequence_stream(stream, small_then_large(), "1 minute"),
        str(tmp_path / "out"), str(tmp_path / "chk"), every=None)
    query.awaitTermination()
    assert [(r.id, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", T + 10_000)]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 2  # the row's copies in the two buckets that see it


def test_restart_goes_on_without_repeating(spark, tmp_path):
    rows = random_events(400, 2, seed=5)
    chunks = shuffled_chunks(rows, 100, 20, seed=2)
    rule = RULES["pair"]

    def run():
        stream = as_events(read_stream(spark, tmp_path / "in", EVENTS))
        return drain(match_sequence_stream(stream, rule, "1 minute"), str(tmp_path / "out"), str(tmp_path / "chk"))

    write_files(tmp_path / "in", chunks[:2])
    before = run().count()
    write_files(tmp_path / "in", [*chunks[2:], [SENTINEL]], start=2)
    found = run()
    expected = match_sequence(as_events(spark.createDataFrame([tuple(r.values()) for r in rows], EVENTS)), rule)
    assert 0 < before < expected.count()
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def alert(who, rule, ts):
    return {"id": who, "rule": rule, "ts": ts}


def silver(frame):
    return alert_plans.silver_alerts(with_event_time(frame))


def test_gold_streams_equal_batch(spark, tmp_path):
    draw = random.Random(3)
    rules = ["SMALL_THEN_LARGE", "INSIDER_EXFIL", "FRAUD_OTHER"]
    rows = [alert(f"e{draw.randrange(6)}", draw.choice(rules), T + i * 400_000) for i in range(500)]
    write_files(tmp_path / "in", [*shuffled_chunks(rows, 250, 4, seed=4), [alert("zz", "X", T + 30 * DAY)]])
    batch = silver(spark.createDataFrame([tuple(r.values()) for r in rows], ALERT))
    for build in (gold.alert_dashboard, gold.daily_alert_summary, gold.alert_patterns,
                  gold.pattern_entities, gold.executive_dashboard):
        stream = build(silver(read_stream(spark, tmp_path / "in", ALERT)))
        found = drain(stream, str(tmp_path / build.__name__), str(tmp_path / f"chk-{build.__name__}"))
        expected = build(batch)
        assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty(), build.__name__


@pytest.fixture
def feature_streams(spark, tmp_path):
    """The combined fixture as three streams with one file per trigger, and far sentinels."""
    sentinels = [5 * DAY, 10 * DAY, 15 * DAY]
    write_files(tmp_path / "alerts", [
        [alert("c1", "SMALL_THEN_LARGE", T + 100_000), alert("u1", "INSIDER_EXFIL", T + 200_000),
         alert("zz", "SMALL_THEN_LARGE", T + 300_000)],
        *[[alert("s", "SENTINEL", T + at)] for at in sentinels]])
    write_files(tmp_path / "txn", [
        [{"cardId": "c1", "amount": a, "ts": T + t} for a, t in [(3.0, 50_000), (700.0, 99_000), (9.0, 9_000_000)]],
        *[[{"cardId": "s", "amount": 1.0, "ts": T + at}] for at in sentinels]])
    write_files(tmp_path / "insider", [
        [{"actor": "u1", "type": k, "ts": T + t} for k, t in [("PRIV_ESC", 150_000), ("EXT_SHARE", 190_000)]],
        *[[{"actor": "s", "type": "PRIV_ESC", "ts": T + at}] for at in sentinels]])

    def fraud(source):
        return source.selectExpr("cardId", "amount", "timestamp_millis(ts) AS event_time")

    return (
        silver(read_stream(spark, tmp_path / "alerts", ALERT)),
        fraud(read_stream(spark, tmp_path / "txn", "cardId string, amount double, ts long")),
        read_stream(spark, tmp_path / "insider", "actor string, type string, ts long").selectExpr(
            "actor", "type", "timestamp_millis(ts) AS event_time"),
        fraud(spark.read.schema("cardId string, amount double, ts long").json(str(tmp_path / "txn"))),
    )


def test_combined_stream(feature_streams, tmp_path):
    alerts, fraud, insider, _ = feature_streams
    found = drain(
        stream_combined_threat_analytics(alerts, fraud, insider, delay="1 hour"),
        str(tmp_path / "out"), str(tmp_path / "chk"))
    got = {r.alert_type: r for r in found.where("date = '2024-01-01'").collect()}
    row = got["INSIDER_THREAT"]
    assert (row.alert_count, row.total_amount_affected, row.cards_involved, row.actors_involved) == (2, None, 0, 1)
    row = got["FRAUD_TRANSACTION"]
    assert (row.alert_count, row.total_amount_affected, row.cards_involved, row.actors_involved) == (3, 703.0, 1, 0)
    assert row.threat_level == "MODERATE"


def test_stream_joins(feature_streams, tmp_path):
    alerts, fraud, insider, table = feature_streams
    pairs = {("c1", 3.0), ("c1", 700.0), ("u1", None), ("zz", None)}
    for name, right in (("stream", fraud), ("table", table)):
        found = drain(
            stream_alerts_with_payments(alerts, right, "1 hour").select("id", "amount"),
            str(tmp_path / name), str(tmp_path / f"chk-{name}"))
        assert {tuple(r) for r in found.where("id != 's'").collect()} == pairs
    found = drain(
        stream_alerts_with_activity(alerts, insider, "1 hour").select("id", "type"),
        str(tmp_path / "act"), str(tmp_path / "chk-act"))
    assert {tuple(r) for r in found.where("id != 's'").collect()} == {
        ("c1", None), ("u1", "PRIV_ESC"), ("u1", "EXT_SHARE"), ("zz", None)}


def test_quality_counts_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"type":"TXN","ts":1}\n{"type":"OTHER"}\n{bad\n')
    from wardline.plans.events import bronze_events
    from wardline.sources.topics import read_lines

    lines = read_lines(spark, str(tmp_path / "in"))
    assert {"file_path", "file_name", "file_modification_time"} <= set(lines.columns)
    query = write_stream(
        bronze_events(lines.select("value"), observe="events"), str(tmp_path / "out"), str(tmp_path / "chk"), every=None)
    query.awaitTermination()
    seen = query.recentProgress[0]["observedMetrics"]["events"]
    assert (seen["rows"], seen["has_ts"], seen["valid_type"]) == (3, 2, 2)
    assert spark.read.schema(EVENT).parquet(str(tmp_path / "out")).count() == 1


def test_messages_to_alerts(spark, tmp_path):
    """The detection job from topic messages on, with files in place of a topic."""
    from wardline.jobs import detect_alerts

    def message(seq, body, at):
        return {"seq": seq, "value": body if isinstance(body, str) else json.dumps(body), "timestamp": at}

    chunks = [[
        message(1, {"type": "TXN", "cardId": "c", "amount": "1.5", "ts": T}, "2024-01-01T00:00:00Z"),
        message(2, "{bad", "2024-01-01T00:00:01Z"),
        message(3, {"type": "TXN", "cardId": "c", "amount": 900}, "2024-01-01T00:00:10Z"),
    ], [message(4, {"type": "TXN", "cardId": "z", "amount": 50, "ts": T + 10 * DAY}, "2024-01-11T00:00:00Z")]]
    write_files(tmp_path / "in", chunks)
    messages = read_stream(spark, tmp_path / "in", "seq long, value string, timestamp timestamp")
    found = drain(detect_alerts(messages, small_then_large(), "1 minute"), str(tmp_path / "out"), str(tmp_path / "chk"))
    assert [tuple(r) for r in found.collect()] == [("c", "SMALL_THEN_LARGE", T + 10_000)]


def test_decoding_works_on_streams(spark, tmp_path):
    write_files(tmp_path / "in", [[{"value": '{"type":"TXN","ts":5}'}]])
    stream = decode_events(read_stream(spark, tmp_path / "in", "value string"), "strict", default_ts=F.lit(0).cast("long"))
    assert drain(stream, str(tmp_path / "out"), str(tmp_path / "chk")).head().type == "TXN"


def test_static_side_is_read_in_part(spark, tmp_path):
    """Each micro-batch meets only the payments near its own alerts, and all of those."""
    rows = [alert("a", "SMALL_THEN_LARGE", T + i * 3_600_000) for i in range(6)]
    write_files(tmp_path / "in", [rows[:2], [alert("a", "FRAUD", None)], rows[2:]])
    payments = spark.createDataFrame(
        [("a", float(i), T + i * 600_000) for i in range(80)], "cardId string, amount double, ts long"
    ).selectExpr("cardId", "amount", "timestamp_millis(ts) AS event_time")
    periods = []

    def side(first, last):
        periods.append((first, last))
        return payments.where(F.unix_millis("event_time").between(first, last))

    stream = silver(read_stream(spark, tmp_path / "in", ALERT))
    join_by_batch(stream, side, gold.alerts_with_payments, str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    alerts = silver(spark.createDataFrame([tuple(r.values()) for r in [*rows, alert("a", "FRAUD", None)]], ALERT))
    expected = gold.alerts_with_payments(alerts, payments).select(found.columns)
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    hour = 3_600_000
    assert periods == [(T - hour, T + 2 * hour), (0, 0), (T + hour, T + 6 * hour)]
