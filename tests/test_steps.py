"""Matches with the events they are made of, and the most affected entities of a pattern, against plain models."""

import random
from collections import Counter, defaultdict

import pytest

from test_timeouts import RULES, events_of
from wardline.operators.sequence import match_sequence, sequence_steps
from wardline.plans import gold


def model(rows, rule):
    """Matches of (seq, key, type, amount, ts) as (key, ((step, ts, seq, amount), ...))."""
    wanted = [step.where.split("'")[1] for step in rule.steps]
    out = Counter()
    for key in {row[1] for row in rows}:
        mine = sorted((row[4], row[0], row[2], row[3]) for row in rows if row[1] == key and row[4] is not None)
        for at, (ts, seq, kind, amount) in enumerate(mine):
            if kind != wanted[0]:
                continue
            path = [(rule.steps[0].name, ts, seq, amount)]
            for then, number, found, paid in mine[at + 1:]:
                if len(path) == len(wanted) or then >= ts + 10_000:
                    break
                if found == wanted[len(path)]:
                    path.append((rule.steps[len(path)].name, then, number, paid))
                elif not rule.steps[len(path)].skip:
                    break
            if len(path) == len(wanted):
                out[key, tuple(path)] += 1
    return out


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("bucket_spans", [1, 8])
def test_steps_of_a_table(spark, events, name, bucket_spans):
    rule = RULES[name]
    rows = [(seq, key, kind, None if seq % 7 == 0 else seq / 4, ts) for seq, key, kind, _, ts in events_of(len(name) + 50)]
    frame = events(rows)
    found = sequence_steps(frame, rule, "amount", bucket_spans=bucket_spans)
    got = found.collect()
    want = model(rows, rule)
    assert want and Counter((r.id, tuple(map(tuple, r.steps))) for r in got) == want
    plain = match_sequence(frame, rule, bucket_spans)
    assert Counter(tuple(r)[:5] for r in got) == Counter(map(tuple, plain.collect()))
    assert found.columns == [*plain.columns, "steps"]


def test_steps_may_carry_nothing_and_empty_tables(spark, events):
    rows = events_of(3)
    got = sequence_steps(events(rows), RULES["skips"]).collect()
    assert got and set(got[0].steps[0].asDict()) == {"step", "ts", "seq"}
    assert sequence_steps(events(rows).where("false"), RULES["skips"], "amount").collect() == []


def test_steps_shuffle_once(spark, events):
    plan = sequence_steps(events(events_of(3)), RULES["mixed"], "amount")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_top_entities(spark, most):
    draw = random.Random(most)
    counts = {(window, rule, f"e{i}"): draw.choice([1, 1, 2, 3]) for window in (1, 2) for rule in ("A", None) for i in range(40 * window)}
    counts[1, "A", "only"] = 90
    rows = [(w, w + 1, rule, "kind", entity, n) for (w, rule, entity), n in counts.items()] + [(9, 10, "B", None, "alone", 4)]
    schema = "window_start long, window_end long, rule string, alert_type string, entity string, alerts long"
    frame = spark.createDataFrame(rows, schema).repartition(5)
    groups = defaultdict(list)
    for w, end, rule, kind, entity, n in rows:
        groups[w, end, rule, kind].append((-n, entity))
    want = {}
    for key, own in groups.items():
        shown, total = sorted(own)[:most], -sum(n for n, _ in own)
        listed = tuple((entity, -n) for n, entity in shown)
        want[key] = (len(own), total, listed, len(own) - len(shown), total - sum(n for _, n in listed))
    found = gold.top_entities(frame, most)
    got = {tuple(r)[:4]: (r.entities, r.alerts, tuple(map(tuple, r.top)), r.rest_entities, r.rest_alerts) for r in found.collect()}
    assert got == want
    assert gold.top_entities(frame.where("false"), most).collect() == []
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
