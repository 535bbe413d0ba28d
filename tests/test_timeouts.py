"""Sequences that run out of time, against a plain model, in batch and on replays with awkward users."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from conftest import SMALL, T
from wardline.operators.sequence import SequenceRule, followed_by, match_sequence, next_step, sequence_timeouts
from wardline.session import scratch_path
from wardline.sources import adapters
from wardline.streaming.runs import drain
from wardline.streaming.sequence import sequence_outcomes_stream

RULES = {
    "strict": SequenceRule("STRICT", "actor", (next_step("a", "type = 'A'"), next_step("b", "type = 'B'"), next_step("c", "type = 'C'")), "10 seconds"),
    "skips": SequenceRule("SKIPS", "actor", (next_step("a", "type = 'A'"), followed_by("b", "type = 'B'"), followed_by("c", "type = 'C'")), "10 seconds"),
    "mixed": SequenceRule("MIXED", "actor", (next_step("a", "type = 'A'"), followed_by("b", "type = 'B'"), next_step("a2", "type = 'A'")), "10 seconds"),
}


def model(rows, rule):
    """Matches and timeouts of (seq, key, type, amount, ts), each sequence followed by itself."""
    wanted = [step.where.split("'")[1] for step in rule.steps]
    out = Counter()
    for key in {row[1] for row in rows}:
        mine = sorted((row[4], row[0], row[2]) for row in rows if row[1] == key and row[4] is not None)
        for at, (ts, seq, kind) in enumerate(mine):
            if kind != wanted[0]:
                continue
            deadline, step = ts + 10_000, 1
            for then, _, found in mine[at + 1:]:
                if step == len(wanted) or then >= deadline:
                    break
                if found == wanted[step]:
                    step, last = step + 1, then
                elif not rule.steps[step].skip:
                    step = None
                    break
            if step == len(wanted):
                out[key, last, ts, seq, None] += 1
            elif step:
                out[key, deadline, ts, seq, rule.steps[step].name] += 1
    return out


def events_of(seed, count=300):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["k1", "k1", "k2", "k3"]), draw.choice("AABBCX"), 1.0, T + 500 * draw.randrange(400)) for i in range(count)]
    return rows + [(count, "k1", "A", 1.0, None), (count + 1, "last", "A", 1.0, T + 200_000)]


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("bucket_spans", [1, 8])
def test_timeouts_of_a_table(spark, events, name, bucket_spans):
    rows, rule = events_of(len(name)), RULES[name]
    frame = events(rows)
    found = [(r.id, r.ts, r.first_ts, r.first_seq, r.waited_for) for r in sequence_timeouts(frame, rule, bucket_spans).collect()]
    found += [(r.id, r.ts, r.first_ts, r.first_seq, None) for r in match_sequence(frame, rule, bucket_spans).collect()]
    assert Counter(found) == model(rows, rule)


def test_no_events(spark, events):
    assert sequence_timeouts(events(events_of(1)).limit(0), RULES["strict"]).collect() == []


@pytest.mark.parametrize("name", RULES)
def test_outcomes_of_a_stream(spark, events, name):
    """Files in time order, each of a quarter of the time, then two events far ahead that move the watermark."""
    rows, rule = events_of(7), RULES[name]
    path = scratch_path(spark, "timeout-events")
    for part in range(4):
        some = [row for row in rows if row[4] is not None and (part * 50_000 <= row[4] - T < (part + 1) * 50_000 or part == 3 and row[4] - T == 200_000)]
        events(some).coalesce(1).write.mode("append").parquet(path)
    for far in (10, 20):
        events([(-far, "flush", "X", 1.0, T + far * 10_000_000)]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = drain(sequence_outcomes_stream(stream, rule, "1 second"), scratch_path(spark, "out"), scratch_path(spark, "checkpoint"))
    assert Counter((r.id, r.ts, r.first_ts, r.first_seq, r.waited_for) for r in out.collect()) == model(rows, rule)


@pytest.fixture(scope="module")
def with_minus_one(spark):
    """The small events with a fifth of the users renamed to -1."""
    path = scratch_path(spark, "minus-one")
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    table.selectExpr("event_id", "ts", "CAST(CASE WHEN user_id % 5 = 0 THEN -1 ELSE user_id END AS BIGINT) AS user_id", "event_type",
                     "value", "props").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["gold_alert_pattern_entities", "sequence_timeouts"])
def test_a_user_named_minus_one_keeps_its_results(spark, with_minus_one, name):
    queries = entry.queries()
    batch, stream = (Counter(map(tuple, queries[n](spark, with_minus_one).collect())) for n in (name, f"{name}_stream"))
    assert batch == stream and any(row[0] == "-1" or "-1" in row for row in batch)


def test_replay_of_an_empty_table(spark):
    path = scratch_path(spark, "empty-events")
    spark.read.parquet(f"{SMALL}/events.parquet").limit(0).write.parquet(f"{path}/events.parquet")
    for name in ("sequence_timeouts_stream", "gold_executive_dashboard_stream"):
        assert entry.queries()[name](spark, path).collect() == []
    assert adapters.flush_user(spark.read.parquet(f"{path}/events.parquet")) == -1
