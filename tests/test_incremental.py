"""Gold kept up to date by batches, update-mode tables and estimated distinct counts."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import T
from wardline.operators.decode import with_event_time
from wardline.plans import alerts as alert_plans
from wardline.plans import gold, incremental, reports
from wardline.session import scratch_path
from wardline.streaming import upserts

DAY, HOUR = 86_400_000, 3_600_000


def silver_of(spark, rows):
    return alert_plans.silver_alerts(with_event_time(spark.createDataFrame(rows, "id string, rule string, ts long")))


def payments_of(spark, rows):
    return with_event_time(spark.createDataFrame(rows, "cardId string, amount double, ts long")).drop("ts")


def activity_of(spark, rows):
    return with_event_time(spark.createDataFrame(rows, "actor string, type string, ts long")).drop("ts")


def batch_of(seed, days):
    """Alerts, payments and activity on ``days``, many close to midnight, some without a time."""
    draw = random.Random(seed)

    def at():
        return T + draw.choice(days) * DAY + draw.choice([draw.randrange(DAY), draw.randrange(HOUR), DAY - 1 - draw.randrange(HOUR)])

    who = lambda: draw.choice(["a", "b", "c"])
    alerts = [(who(), draw.choice(["SMALL_THEN_LARGE", "INSIDER_EXFIL", "X"]), at()) for _ in range(60)]
    return (alerts, [(who(), draw.uniform(1, 90), at()) for _ in range(60)], [(who(), draw.choice(["PRIV_ESC", "BULK_EXPORT"]), at()) for _ in range(60)])


def frames(spark, batch):
    return silver_of(spark, batch[0]), payments_of(spark, batch[1]), activity_of(spark, batch[2])


def rounded(frame):
    out = Counter()
    for row in frame.collect():
        out[tuple(f"{v:.6f}" if isinstance(v, float) else repr(v) for _, v in sorted(row.asDict().items()))] += 1
    return out


def rebuilt(spark, batches):
    silver, fraud, insider = frames(spark, [sum((batch[i] for batch in batches), []) for i in range(3)])
    found = {name: build(silver) for name, build in incremental.TABLES.items() if build}
    return found | {"gold_combined_threat_analytics": gold.combined_threat_analytics(silver, fraud, insider)}


def files(root):
    return {os.path.join(at, name): os.stat(os.path.join(at, name)).st_mtime_ns for at, _, names in os.walk(root) for name in names if name.endswith(".parquet")}


@pytest.fixture(scope="module")
def stored(spark):
    """Three batches: two days, the day after, and late rows of the first day; with the files before and after the last."""
    store = incremental.DailyGold(scratch_path(spark, "daily"))
    batches = [batch_of(1, [0, 1]), batch_of(2, [3]), batch_of(3, [0])]
    batches[0][0].append(("z", "X", None))
    days = [store.add(str(i), *frames(spark, batch)) for i, batch in enumerate(batches[:2])]
    before = files(store.root)
    days.append(store.add("2", *frames(spark, batches[2])))
    return store, batches, days, before


@pytest.mark.parametrize("name", incremental.TABLES)
def test_equals_a_full_rebuild(spark, stored, name):
    store, batches, _, _ = stored
    assert rounded(store.read(spark, name)) == rounded(rebuilt(spark, batches)[name])


@pytest.mark.parametrize("name", incremental.TABLES)
def test_only_touched_days_are_written(stored, name):
    store, _, days, before = stored
    assert days[1][name] <= {"2024-01-03", "2024-01-04", "2024-01-05"} and "2024-01-04" in days[1][name]
    assert days[2][name] <= {"2023-12-31", "2024-01-01", "2024-01-02"}
    now = files(store.path(name))
    kept = [path for path in now if "2024-01-04" in path]
    assert kept and all(before.get(path) == now[path] for path in kept)
    assert any(before.get(path) != now[path] for path in now if "2024-01-01" in path)


def test_a_repeated_batch_changes_nothing(spark, stored):
    store, batches, _, _ = stored
    store.add("2", *frames(spark, batches[2]))
    for name, rows in rebuilt(spark, batches).items():
        assert rounded(store.read(spark, name)) == rounded(rows)


def test_late_payments_rebuild_the_day_of_the_alerts(spark):
    store = incremental.DailyGold(scratch_path(spark, "daily"))
    alerts, no_alerts = [("a", "X", T + DAY - 60_000)], silver_of(spark, [("a", "X", T)]).limit(0)
    nothing = activity_of(spark, [("a", "X", T)]).limit(0)
    store.add("1", silver_of(spark, alerts), payments_of(spark, [("a", 1.0, T)]), nothing)
    name = "gold_combined_threat_analytics"
    assert store.read(spark, name).first()["total_amount_affected"] is None
    days = store.add("2", no_alerts, payments_of(spark, [("a", 70.0, T + DAY + 60_000)]), nothing)
    assert "2024-01-01" in days[name] and days["gold_daily_alert_summary"] == set()
    assert [r["total_amount_affected"] for r in store.read(spark, name).collect()] == [70.0]


def test_reports_read_their_days_alone(spark, stored):
    store = stored[0]
    for report, name in ((reports.daily_summary_week, "gold_daily_alert_summary"), (reports.executive_month, "gold_executive_dashboard")):
        plan = report(store.read(spark, name), "2024-01-09 10:00:00")._jdf.queryExecution().toString()
        scan = next(line for line in plan[plan.index("== Physical Plan =="):].splitlines() if "FileScan" in line)
        assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan
    found = reports.daily_summary_week(store.read(spark, "gold_daily_alert_summary"), "2024-01-09 10:00:00").collect()
    assert {r.date for r in found} == {"2024-01-02", "2024-01-04"}


def test_batches_without_rows(spark):
    store = incremental.DailyGold(scratch_path(spark, "daily"))
    empty = [frame.limit(0) for frame in frames(spark, batch_of(1, [0]))]
    assert set(map(len, store.add("1", *empty).values())) == {0}
    for name, rows in rebuilt(spark, [batch_of(1, [0])]).items():
        assert store.read(spark, name).collect() == [] and set(store.read(spark, name).columns) == set(rows.columns)


KEYS = ["k"]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, n long")


def test_latest_row_of_each_key(spark):
    path = scratch_path(spark, "upserts")
    schema = table(spark, [("a", 1)]).schema
    assert upserts.current(spark, path, KEYS, schema).collect() == []
    upserts.write_changes(table(spark, [("a", 1), ("b", 1), (None, 1)]), 0, path)
    for _ in range(2):  # a batch that runs again
        upserts.write_changes(table(spark, [("a", 2), (None, 5)]), 1, path)
    want = {("a", 2), ("b", 1), (None, 5)}
    held = lambda: sorted(map(tuple, upserts.current(spark, path, KEYS, schema).collect()), key=str)
    assert set(held()) == want and len(held()) == 3
    upserts.snapshot(spark, path, KEYS, schema)
    upserts.snapshot(spark, path, KEYS, schema)
    assert set(held()) == want and len(held()) == 3
    upserts.write_changes(table(spark, [("b", 9)]), 2, path)
    table(spark, [("b", 100)]).write.parquet(f"{path}/changes/batch=3")
    os.remove(f"{path}/changes/batch=3/_SUCCESS")  # as if it were being written
    assert set(held()) == {("a", 2), ("b", 9), (None, 5)}


def test_a_stream_in_update_mode(spark):
    """Counts grow from batch to batch; the table holds the last of each, also after the last batch runs again."""
    path, out, checkpoint = (scratch_path(spark, name) for name in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([(1, "a")], "ts long, id string").schema
    for part in range(3):
        spark.createDataFrame([(T + part * 1000 + i, f"u{i % 7}") for i in range(50)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    counted = stream.withWatermark("event_time", "1 hour").groupBy(F.window("event_time", "5 minutes").start.alias("k")).agg(F.count("*").alias("n"))
    upserts.upsert_stream(counted, out, checkpoint).awaitTermination()
    batches = sorted(os.listdir(f"{out}/changes"))
    assert len(batches) >= 3
    held = lambda: [r.n for r in upserts.current(spark, out, KEYS, counted.schema).collect()]
    assert held() == [150]
    last = max(int(name.split("=")[1]) for name in batches if name.startswith("batch="))
    upserts.write_changes(spark.createDataFrame([r.asDict() for r in upserts.current(spark, out, KEYS, counted.schema).collect()], counted.schema), last, out)
    assert held() == [150]


def test_sketches_are_close_and_merge(spark):
    rows = spark.range(200_000).selectExpr("CAST(id % 30000 AS STRING) AS id", "'INSIDER_EXFIL' AS rule", f"{T} + id * 400 AS ts")
    silver = alert_plans.silver_alerts(with_event_time(rows))
    day = gold.daily_alert_summary(silver, distinct="approx").first()
    rolled = gold.daily_entities(gold.entity_sketches(silver)).first()
    assert abs(day.unique_entities_affected - 30000) <= 600 and abs(rolled.unique_entities_affected - 30000) <= 600
    assert day.total_alerts == rolled.total_alerts == 200_000 and day.rules_triggered == ["INSIDER_EXFIL"]


def test_sketches_of_missing_entities(spark):
    silver = silver_of(spark, [(None, "X", T), (None, "X", T + 1), ("a", "Y", None)])
    found = gold.alert_dashboard(silver, distinct="approx").collect()
    assert [(r.alert_count, r.unique_entities) for r in found] == [(2, 0)]
    assert {(r.date, r.unique_entities_affected) for r in gold.daily_alert_summary(silver, distinct="approx").collect()} == {("2024-01-01", 0), (None, 1)}
