"""The combined table on streams: equal to the batch table, with state that does not grow with the entities."""

import math
import random

import pandas as pd
import pytest

from conftest import T
from test_streaming import DAY, alert, read_stream, silver, write_files
from wardline.plans import gold
from wardline.schemas import ALERT
from wardline.streaming.combined import SLOTS, stream_combined_threat_analytics
from wardline.streaming.runs import write_stream
from wardline.streaming.threats import ACTIVITY, ALERT as ALERTED, PAYMENT, day_threats

HOUR = 3_600_000
PAYMENTS, ACTIVITIES = "cardId string, amount double, ts long", "actor string, type string, ts long"


def day_of(seed):
    """Alerts, payments and activities over two days, many around midnight, with missing ids, types and amounts."""
    draw = random.Random(seed)

    def at():
        return T + draw.choice([draw.randrange(2 * DAY), DAY + draw.randrange(-HOUR, HOUR), DAY + 3_600_000 * draw.choice([-1, 1])])

    who = [None, "hot", "hot", *[f"u{i}" for i in range(300)]]
    rules = ["SMALL_THEN_LARGE", "INSIDER_EXFIL", "FRAUD_OTHER"]
    return (
        [alert(draw.choice(who), draw.choice(rules), at()) for _ in range(900)],
        [{"cardId": draw.choice(who), "amount": draw.choice([None, 1.25, 1e18, 20.0]), "ts": at()} for _ in range(900)],
        [{"actor": draw.choice(who), "type": draw.choice([None, "PRIV_ESC", "EXT_SHARE"]), "ts": at()} for _ in range(900)],
    )


def test_stream_equals_table_in_bounded_state(spark, tmp_path):
    alerts, paid, acted = day_of(1)
    far = [T + 20 * DAY * n for n in (1, 2, 3)]
    parts = {
        "alerts": (alerts, [alert("s", "SENTINEL", at) for at in far]),
        "txn": (paid, [{"cardId": "s", "amount": 1.0, "ts": at} for at in far]),
        "insider": (acted, [{"actor": "s", "type": "PRIV_ESC", "ts": at} for at in far]),
    }
    streams, tables = [], []
    for (name, (rows, last)), schema in zip(parts.items(), (ALERT, PAYMENTS, ACTIVITIES)):
        first = [row for row in rows if row["ts"] < T + DAY]
        write_files(tmp_path / name, [first, [row for row in rows if row["ts"] >= T + DAY], *[[row] for row in last]])
        streams.append(read_stream(spark, tmp_path / name, schema))
        tables.append(spark.createDataFrame(pd.DataFrame(rows).astype(object).where(lambda x: x.notna(), None).to_dict("records"), schema))

    def sides(alerts, paid, acted):
        timed = [frame.selectExpr("*", "timestamp_millis(ts) AS event_time") for frame in (paid, acted)]
        return silver(alerts), *timed

    query = write_stream(
        stream_combined_threat_analytics(*sides(*streams), delay="3 hours"), str(tmp_path / "out"), str(tmp_path / "chk"), every=None)
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).where("date < '2024-01-10'").collect()
    expected = gold.combined_threat_analytics(*sides(*tables)).collect()

    def shown(rows):
        return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row.asDict().values()) for row in rows)

    assert shown(found) == shown(expected) and len(expected) > 3
    held = [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]
    # Per slot and day: a block, a timer in its two indexes, a key. Held row by row, 2700 rows would be far more.
    assert max(held) <= 4 * SLOTS * 4 < 2700


@pytest.mark.parametrize("odd", [float("inf"), float("-inf"), float("nan"), 1e300])
def test_amounts_outside_the_band_leave_no_trace(odd):
    rows = pd.DataFrame([
        (ALERTED, "a", 10_000, "R", None, False, "X", "HIGH"), (ALERTED, None, 10_000, "R", None, False, "X", "HIGH"),
        (PAYMENT, "a", 10_000 - 3600, None, odd, True, None, None), (PAYMENT, "a", 10_000 + 3599, None, 2.5, True, None, None),
        (PAYMENT, "a", 10_000 + 3600, None, odd, True, None, None), (PAYMENT, "b", 10_000, None, odd, True, None, None),
        (PAYMENT, "a", 10_001, None, None, False, None, None), (ACTIVITY, "a", 6401, "EXT_SHARE", None, False, None, None),
        (ACTIVITY, "a", 6400, "PRIV_ESC", None, False, None, None),
    ], columns=["kind", "id", "at", "name", "amount", "has_amount", "alert_type", "severity"])
    (row,) = day_threats(rows, 3599).itertuples(index=False)
    assert tuple(row) == ("X", "HIGH", 3, 2.5, 1, 1, 1, ["R"], ["EXT_SHARE"])
    (row,) = day_threats(rows.assign(at=rows["at"].clip(9_000, 11_000)), 3599).itertuples(index=False)
    assert row.paid == 2 * (2 * odd + 2.5) or math.isnan(odd) and math.isnan(row.paid)
    assert (row.alert_count, row.amounts, row.types) == (9, 6, ["EXT_SHARE", "PRIV_ESC"])
