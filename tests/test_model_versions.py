"""Models that follow each other, on tables and on a running stream."""

import math

import pytest

from wardline.operators import model_versions, scoring
from wardline.session import scratch_path
from wardline.streaming import upserts
from wardline.streaming.models import score_stream_by_version

OLD = scoring.LinearModel((1.0, 0.5), -1.0, (10.0, 12.0), (5.0, 6.0))
NEW = scoring.LinearModel((-2.0, 0.5), 0.5, (20.0, 11.0), (4.0, 0.0))  # a feature that never varied counts for nothing
PAYMENTS = "cardId string, amount double, event_time timestamp"


def payments(spark, rows):
    frame = spark.createDataFrame(rows, "cardId string, amount double, event_time string")
    return frame.withColumn("event_time", frame.event_time.cast("timestamp"))


def plain(model, amount, hour):
    logit = model.intercept
    for x, c, mean, std in zip((amount, hour), model.coefficients, model.means, model.stds):
        logit += c * (x - mean) / std if std > 0 else 0
    return 1 / (1 + math.exp(-logit))


ROWS = [
    ("before", 10.0, "2024-01-01 09:59:59"), ("first", 10.0, "2024-01-01 10:00:00"), ("last", 30.0, "2024-01-02 07:59:59"),
    ("new", 30.0, "2024-01-02 08:00:00"), ("late", 1.0, "2024-06-01 23:00:00"), ("timeless", 5.0, None),
    ("blank", None, "2024-01-02 09:00:00"), ("odd", float("nan"), "2024-01-01 11:00:00"), ("last", 30.0, "2024-01-02 07:59:59"),
]


def published(spark):
    path = scratch_path(spark, "test-models")
    model_versions.publish(spark, path, 1, "2024-01-01 10:00:00", OLD)
    model_versions.publish(spark, path, 5, "2024-01-02 08:00:00", OLD)
    model_versions.publish(spark, path, 7, "2024-01-02 08:00:00", OLD)
    model_versions.publish(spark, path, 7, "2024-01-02 08:00:00", NEW)  # again: overwritten
    return path


def test_the_version_at_the_time_scores(spark):
    path = published(spark)
    assert model_versions.versions(spark, path).count() == 3
    frame = payments(spark, ROWS)
    got = model_versions.score_by_version(frame, model_versions.versions(spark, path))
    assert got.columns == [*frame.columns, "version", "score"]
    found = [(r.cardId, r.version, r.score) for r in got.collect()]
    assert len(found) == len(ROWS)
    by_card = {card: (version, score) for card, version, score in found}
    assert by_card["before"] == by_card["timeless"] == (None, 0.0)
    assert by_card["blank"] == (7, 0.0) and by_card["odd"] == (1, 0.0)
    for card, version, model, amount, hour in (("first", 1, OLD, 10, 10), ("last", 1, OLD, 30, 7), ("new", 7, NEW, 30, 8), ("late", 7, NEW, 1, 23)):
        assert by_card[card][0] == version and by_card[card][1] == pytest.approx(plain(model, amount, hour))


def test_empty_tables(spark):
    frame, none = payments(spark, ROWS), model_versions.versions(spark, published(spark)).where("false")
    assert {(r.version, r.score) for r in model_versions.score_by_version(frame, none).collect()} == {(None, 0.0)}
    assert model_versions.score_by_version(frame.where("false"), model_versions.versions(spark, published(spark))).collect() == []


def test_a_stream_without_rows(spark):
    source, path = scratch_path(spark, "test-none"), scratch_path(spark, "test-none-scored")
    payments(spark, ROWS).where("false").write.parquet(source)
    stream = spark.readStream.schema(PAYMENTS).parquet(source)
    score_stream_by_version(stream, published(spark), path, scratch_path(spark, "test-none-checkpoint")).awaitTermination()
    assert upserts.written(spark, path, f"{PAYMENTS}, version long, score double, decision boolean").collect() == []


def test_no_join_and_no_shuffle(spark):
    plan = model_versions.score_by_version(payments(spark, ROWS), model_versions.versions(spark, published(spark)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text


def test_a_model_published_while_the_stream_goes_on(spark):
    source, models, path, checkpoint = (scratch_path(spark, f"test-{x}") for x in ("payments", "models", "scored", "checkpoint"))
    model_versions.publish(spark, models, 1, "2024-01-01 00:00:00", OLD)
    day = "2024-03-01 12:00:00"
    payments(spark, [("a", 12.0, day), ("b", None, day)]).write.parquet(source)
    stream = spark.readStream.schema(PAYMENTS).option("maxFilesPerTrigger", 1).parquet(source)

    query = score_stream_by_version(stream, models, path, checkpoint, every="1 second")
    try:
        query.processAllAvailable()
        model_versions.publish(spark, models, 2, "2024-02-01 00:00:00", NEW)
        payments(spark, [("c", 12.0, day), ("d", 12.0, "2024-01-31 12:00:00")]).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    found = {r.cardId: (r.version, r.score) for r in spark.read.parquet(f"{path}/changes").collect()}
    assert found["a"] == (1, pytest.approx(plain(OLD, 12, 12))) and found["b"] == (1, 0.0)
    assert found["c"] == (2, pytest.approx(plain(NEW, 12, 12))) and found["d"] == (1, pytest.approx(plain(OLD, 12, 12)))
