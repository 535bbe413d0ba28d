"""The fraud model: training set, training, scoring and the decision, on tables and streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features, label rule, split, iterations and decision threshold.
FEATURES = ("amount", "hour")
LABEL_ABOVE = 120.0
TRAIN_SHARE = 0.8
MAX_ITERATIONS = 200
DECIDE_ABOVE = 0.85


def model_features(payments: DataFrame) -> DataFrame:
    """``payments`` (with ``amount`` and ``event_time``) with the hour of the day."""
    return payments.withColumn("hour", F.hour("event_time"))


def training_set(payments: DataFrame, label_above: float = LABEL_ABOVE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``amount, hour, label`` and the columns to ``keep``; payments without an amount cannot be labelled."""
    label = (F.col("amount") > label_above).cast("double").alias("label")
    return model_features(payments).where("amount IS NOT NULL").select(*FEATURES, label, *keep)


def split(rows: DataFrame, share: float = TRAIN_SHARE, by: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the whole number ``by`` modulo 100, for want of one by a hash of the row: a filter
    each, which neither sorts nor depends on how the rows are partitioned."""
    number = F.xxhash64(*rows.columns) if by is None else by
    is_test = F.coalesce(F.pmod(number, F.lit(100)) >= F.lit(round(100 * share)), F.lit(False))
    return rows.where(~is_test), rows.where(is_test)


def feature_stats(rows: DataFrame) -> DataFrame:
    """Mean and sample standard deviation per feature, as the scaler uses them."""
    return rows.agg(
        F.count("*").alias("n"),
        *[F.avg(name).alias(f"{name}_mean") for name in FEATURES],
        *[F.stddev_samp(name).alias(f"{name}_std") for name in FEATURES],
    )


def train(rows: DataFrame, max_iterations: int = MAX_ITERATIONS, strength: float = 1.0) -> PipelineModel:
    """Scaled logistic regression. ``strength`` is the inverse penalty on the summed loss; Spark
    averages the loss over the rows, hence the division by their number."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    regression = LogisticRegression(
        maxIter=max_iterations, regParam=1.0 / (strength * max(rows.count(), 1)), standardization=False
    )
    return Pipeline(stages=[assembler, scaler, regression]).fit(rows)


@dataclass(frozen=True)
class LinearModel:
    """A trained model in numbers: score = logistic(intercept + Σ coefficient × (x − mean) / std)."""

    coefficients: tuple[float, ...]
    intercept: float
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @classmethod
    def of(cls, model: PipelineModel) -> LinearModel:
        _, scaler, regression = model.stages
        return cls(
            tuple(regression.coefficients.toArray().tolist()), float(regression.intercept),
            tuple(scaler.mean.toArray().tolist()), tuple(scaler.std.toArray().tolist()),
        )

    def probability(self) -> Column:
        logit = F.lit(self.intercept)
        for name, coefficient, mean, std in zip(
            FEATURES, self.coefficients, self.means, self.stds, strict=True
        ):
            if std > 0:
                logit = logit + F.lit(coefficient) * (F.col(name) - F.lit(mean)) / F.lit(std)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _linear(model: LinearModel | PipelineModel) -> LinearModel:
    return model if isinstance(model, LinearModel) else LinearModel.of(model)


def score(payments: DataFrame, model: LinearModel | PipelineModel) -> DataFrame:
    """``payments`` (a table or a stream) with ``score``: 0.0 where the model cannot give one.

    The model enters as its numbers. That is one built-in expression within whole-stage codegen, and
    spares the plan a model object, which carries its training summary and session along and then
    cannot always be sent to executors.
    """
    value = F.coalesce(F.nanvl(_linear(model).probability(), F.lit(0.0)), F.lit(0.0))
    return model_features(payments).select(*payments.columns, value.alias("score"))


def decide(scored: DataFrame, above: float = DECIDE_ABOVE) -> DataFrame:
    return scored.withColumn("decision", F.col("score") > above)


def evaluate(rows: DataFrame, model: LinearModel | PipelineModel) -> DataFrame:
    """Rows, positives and accuracy on labelled ``rows``."""
    predicted = (_linear(model).probability() > 0.5).cast("double")
    return rows.agg(
        F.count("*").alias("n"),
        F.sum(F.col("label").cast("long")).alias("positives"),
        F.avg((predicted == F.col("label")).cast("double")).alias("accuracy"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
