"""Models that follow each other: a table of versions, and scores by the version that holds at a payment's time.

Each version is a folder of its own with one row, so publishing one again overwrites it. A version holds from its
``valid_from`` up to that of the next; of two with one ``valid_from`` the higher number holds. The table has a row per
training, whatever the payments are, and enters the plan as one constant: an as-of join without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.scoring import FEATURES, LinearModel, model_features

SCHEMA = "version long, valid_from timestamp, coefficients array<double>, intercept double, means array<double>, stds array<double>"


def publish(spark: SparkSession, path: str, version: int, valid_from: str, model: LinearModel) -> None:
    """Add ``version`` to the table at ``path``; ``valid_from`` is a timestamp in the session's time zone."""
    row = (version, list(model.coefficients), model.intercept, list(model.means), list(model.stds))
    one = spark.createDataFrame([row], "version long, coefficients array<double>, intercept double, means array<double>, stds array<double>")
    one = one.withColumn("valid_from", F.lit(valid_from).cast("timestamp")).coalesce(1)
    one.write.mode("overwrite").parquet(f"{path}/number={int(version)}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The versions published so far; there must be one."""
    return spark.read.schema(SCHEMA).parquet(path).select("version", "valid_from", "coefficients", "intercept", "means", "stds")


def score_by_version(payments: DataFrame, models: DataFrame) -> DataFrame:
    """``payments`` with the ``version`` that holds at ``event_time`` and its ``score``.

    Before the first version, and without an ``event_time``, the version is null and the score 0.0; a model that cannot
    give a score, for want of an amount, gives 0.0 as well.
    """
    held = models.orderBy("valid_from", "version").collect()  # a row per training
    if not held:
        return payments.select("*", F.lit(None).cast("long").alias("version"), F.lit(0.0).alias("score"))
    at_time = F.filter(F.array(*[_constant(row) for row in held]), lambda one: one["valid_from"] <= F.col("event_time"))
    model = F.when(F.size(at_time) > 0, F.element_at(at_time, -1)).alias("model")
    rows = model_features(payments).select("*", model)
    score = F.coalesce(F.nanvl(_probability(F.col("model")), F.lit(0.0)), F.lit(0.0))
    return rows.select(*payments.columns, F.col("model.version").alias("version"), score.alias("score"))


def _constant(row) -> Column:
    def numbers(name):
        return F.array(*[F.lit(float(value)) for value in row[name]]).alias(name)

    return F.struct(
        F.lit(row["version"]).cast("long").alias("version"), F.lit(row["valid_from"]).alias("valid_from"), numbers("coefficients"),
        F.lit(float(row["intercept"])).alias("intercept"), numbers("means"), numbers("stds"))


def _probability(model: Column) -> Column:
    logit = model["intercept"]
    for place, name in enumerate(FEATURES):
        std = model["stds"][place]
        logit = logit + F.when(std > 0, model["coefficients"][place] * (F.col(name) - model["means"][place]) / std).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
