"""Batch sequence matching: hand-made cases, a plain-Python model, and a key that holds most rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import T
from wardline.operators.sequence import (
    SequenceRule, Step, followed_by, insider_exfil, match_sequence, next_step, rule_for_mode,
    small_then_large, to_alerts,
)

PAIR = small_then_large()


def matched(frame, rule, **options):
    return sorted(tuple(r) for r in to_alerts(match_sequence(frame, rule, **options)).collect())


PAIR_CASES = {
    "plain match": ([(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 700.0, T + 30000)], 1),
    "exactly at the bound": ([(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 700.0, T + 60000)], 0),
    "just inside": ([(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 700.0, T + 59999)], 1),
    "small is strict": ([(1, "c1", "TXN", 5.0, T), (2, "c1", "TXN", 700.0, T + 1)], 0),
    "large is strict": ([(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 500.0, T + 1)], 0),
    "contiguity broken": (
        [(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 50.0, T + 1), (3, "c1", "TXN", 700.0, T + 2)], 0),
    "broken by another type": (
        [(1, "c1", "TXN", 3.0, T), (2, "c1", "REFUND", 1.0, T + 1), (3, "c1", "TXN", 700.0, T + 2)], 0),
    "restart": (
        [(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 4.0, T + 1), (3, "c1", "TXN", 700.0, T + 2)], 1),
    "two pairs": (
        [(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 700.0, T + 1),
         (3, "c1", "TXN", 2.0, T + 2), (4, "c1", "TXN", 900.0, T + 3)], 2),
    "keys interleaved": (
        [(1, "c1", "TXN", 3.0, T), (2, "c2", "TXN", 3.0, T + 1),
         (3, "c1", "TXN", 700.0, T + 2), (4, "c2", "TXN", 700.0, T + 3)], 2),
    "tie in order": ([(1, "c1", "TXN", 3.0, T), (2, "c1", "TXN", 700.0, T)], 1),
    "tie out of order": ([(2, "c1", "TXN", 3.0, T), (1, "c1", "TXN", 700.0, T)], 0),
    "missing amount is small": ([(1, "c1", "TXN", 0.0, T), (2, "c1", "TXN", 700.0, T + 1)], 1),
    "negative amount is small": ([(1, "c1", "TXN", -9.0, T), (2, "c1", "TXN", 700.0, T + 1)], 1),
    "unknown amount matches no step": ([(1, "c1", "TXN", None, T), (2, "c1", "TXN", 700.0, T + 1)], 0),
    "arrival out of order": ([(1, "c1", "TXN", 700.0, T + 30000), (2, "c1", "TXN", 3.0, T)], 1),
    "empty key is a key": ([(1, "", "TXN", 3.0, T), (2, "", "TXN", 700.0, T + 1)], 1),
}


@pytest.mark.parametrize("case", PAIR_CASES)
@pytest.mark.parametrize("spans", [1, 8])
def test_pair(events, case, spans):
    rows, expected = PAIR_CASES[case]
    assert len(matched(events(rows), PAIR, bucket_spans=spans)) == expected


def test_alert_carries_key_rule_and_last_time(events):
    rows = PAIR_CASES["plain match"][0]
    assert matched(events(rows), PAIR) == [("c1", "SMALL_THEN_LARGE", T + 30000)]


def test_skipping_other_events(events):
    rows = PAIR_CASES["broken by another type"][0]
    assert len(matched(events(rows), small_then_large(skip=True))) == 1


P, B, X = "PRIV_ESC", "BULK_EXPORT", "EXT_SHARE"
MIN = 60_000
TRIPLE_CASES = {
    "in order": ([(1, "u", P, None, T), (2, "u", B, None, T + MIN), (3, "u", X, None, T + 2 * MIN)], 1),
    "span at the bound": ([(1, "u", P, None, T), (2, "u", B, None, T + 1), (3, "u", X, None, T + 30 * MIN)], 0),
    "gaps inside, span over": (
        [(1, "u", P, None, T), (2, "u", B, None, T + 20 * MIN), (3, "u", X, None, T + 40 * MIN)], 0),
    "wrong order": ([(1, "u", B, None, T), (2, "u", P, None, T + 1), (3, "u", X, None, T + 2)], 0),
    "middle missing": ([(1, "u", P, None, T), (2, "u", X, None, T + 1)], 0),
    "first repeated": (
        [(1, "u", P, None, T), (2, "u", P, None, T + 1), (3, "u", B, None, T + 2), (4, "u", X, None, T + 3)], 1),
    "equal times": ([(1, "u", P, None, T), (2, "u", B, None, T), (3, "u", X, None, T)], 1),
}


@pytest.mark.parametrize("case", TRIPLE_CASES)
@pytest.mark.parametrize("spans", [1, 8])
def test_triple(events, case, spans):
    rows, expected = TRIPLE_CASES[case]
    got = matched(events(rows), insider_exfil(), bucket_spans=spans)
    assert len(got) == expected
    assert all(alert[:2] == ("u", "INSIDER_EXFIL") for alert in got)


def test_mode_switch():
    assert rule_for_mode("fraud") == small_then_large()
    assert rule_for_mode("insider") == rule_for_mode("anything") == insider_exfil()


def test_one_step_is_no_sequence():
    with pytest.raises(ValueError):
        SequenceRule("R", "cardId", (Step("a", "true"),), "1 minute")


# Rules over events of type a, b, c with every mix of next and followed-by.
MIXES = {
    "".join("f" if skip else "n" for skip in skips): SequenceRule(
        "MIX", "cardId",
        (next_step("a", "type = 'a'"), *[
            (followed_by if skip else next_step)(kind, where)
            for skip, (kind, where) in zip(
                skips, [("b", "type IN ('b', 'a')"), ("c", "type IN ('c', 'b')")])
        ]),
        "10 seconds",
    )
    for skips in [(False,), (True,), (False, False), (False, True), (True, False), (True, True)]
}
WANTED = [{"a"}, {"b", "a"}, {"c", "b"}]


def model(rows, rule):
    """One match per first event, taking the next eligible event for each step."""
    out = []
    for key in {r[1] for r in rows}:
        line = sorted((r for r in rows if r[1] == key), key=lambda r: (r[4], r[0]))
        for i, start in enumerate(line):
            if start[2] not in WANTED[0]:
                continue
            at = i
            for j in range(1, len(rule.steps)):
                at += 1
                while rule.steps[j].skip and at < len(line) and line[at][2] not in WANTED[j]:
                    at += 1
                if at >= len(line) or line[at][2] not in WANTED[j]:
                    break
            else:
                if line[at][4] < start[4] + rule.within_ms:
                    out.append((key, line[at][4], start[4], start[0]))
    return sorted(out)


lines = st.lists(
    st.tuples(st.sampled_from(["k", "l"]), st.sampled_from("abcx"), st.integers(0, 25)),
    min_size=1, max_size=40,
)


@pytest.mark.parametrize("mix", MIXES)
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(drawn=lines)
def test_against_model(events, mix, drawn):
    rows = [(i, key, kind, 0.0, T + 1000 * sec) for i, (key, kind, sec) in enumerate(drawn)]
    rule = MIXES[mix]
    expected = model(rows, rule)
    for spans in (1, 3):
        found = match_sequence(events(rows), rule, spans).select("id", "ts", "first_ts", "first_seq")
        assert sorted(tuple(r) for r in found.collect()) == expected


@pytest.mark.parametrize("mix", MIXES)
def test_hot_key_in_buckets(spark, mix):
    """One key with nearly all rows, most of them at one moment, against the plain model."""
    frame = spark.range(3_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 50 == 0, F.lit("rare")).otherwise("hot").alias("cardId"),
        F.element_at(F.array(*[F.lit(c) for c in "aabcx"]), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("type"),
        F.lit(0.0).alias("amount"),
        (F.lit(T) + F.when(F.col("id") < 1_800, 0).otherwise((F.col("id") % 997) * 100)).alias("ts"),
    )
    found = match_sequence(frame, MIXES[mix], 1).select("id", "ts", "first_ts", "first_seq")
    expected = model([tuple(r) for r in frame.collect()], MIXES[mix])
    assert len(expected) > 10 and sorted(tuple(r) for r in found.collect()) == expected


def test_building_runs_no_job(spark, events):
    frame = events(PAIR_CASES["plain match"][0])
    status = spark.sparkContext.statusTracker()
    before = status.getJobIdsForGroup(None)
    match_sequence(frame, PAIR)
    assert status.getJobIdsForGroup(None) == before


def test_ordinary_keys_need_one_shuffle(events):
    plan = match_sequence(events(PAIR_CASES["plain match"][0]), PAIR)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1
    assert "amount" not in physical[physical.index("Window"):physical.index("Exchange")]
