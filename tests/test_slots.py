"""The stream matcher with many keys to a slot: every key's results, and state that does not grow with the keys."""

import random
from collections import Counter

import pytest

from conftest import T
from test_timeouts import RULES, model
from wardline.session import scratch_path
from wardline.streaming.runs import write_stream
from wardline.streaming.sequence import sequence_outcomes_stream


def many_keys(seed, keys=400, count=2000):
    """Events of many keys and of none, some at one time, a few keys with most of them."""
    draw = random.Random(seed)
    names = [None, *["busy"] * 100, *[f"k{i}" for i in range(keys)]]
    return [(i, draw.choice(names), draw.choice("AABBCX"), 1.0, T + 500 * draw.randrange(400)) for i in range(count)]


@pytest.mark.parametrize("name, slots", [("strict", 1), ("skips", 4), ("mixed", 4)])
def test_many_keys_share_a_slot(spark, events, name, slots):
    rows, rule = many_keys(len(name)), RULES[name]
    path = scratch_path(spark, "slot-events")
    for part in range(4):
        some = [row for row in rows if part * 50_000 <= row[4] - T < (part + 1) * 50_000]
        events(some).coalesce(1).write.mode("append").parquet(path)
    for far in (10, 20):
        events([(-far, "flush", "X", 1.0, T + far * 10_000_000)]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    query = write_stream(sequence_outcomes_stream(stream, rule, "1 second", slots=slots), out, checkpoint, every=None)
    query.awaitTermination()
    found = spark.read.parquet(out).collect()
    assert Counter((r.id, r.ts, r.first_ts, r.first_seq, r.waited_for) for r in found) == model(rows, rule)
    held = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    assert 0 < held <= slots * 30 < 400
