"""Probe data: token-mean activations with the pose to predict, a linear fit and its loss per step."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import as_vectors, token_mean


def readable_prefix(samples: DataFrame, listed: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Samples before the first unreadable one of each group.

    ``listed``: all (keys, index) expected; ``samples``: those that could be read.
    """
    lost = listed.join(samples.select(*keys, index).distinct(), [*keys, index], "left_anti")
    first = lost.groupBy(*keys).agg(F.min(index).alias("_first_lost"))
    j = samples.join(first, keys, "left")
    return j.filter(F.col("_first_lost").isNull() | (F.col(index) < F.col("_first_lost"))).drop("_first_lost")


def probe_dataset(activations: DataFrame, poses: DataFrame, keys: list[str], vector: str = "vec") -> DataFrame:
    """(keys, vector, pose) with the vector averaged over tokens."""
    return as_vectors(token_mean(activations, keys, vector), keys).join(poses, keys)


def fit_linear_probe(data: DataFrame, dims: int, ridge: float = 0.0) -> list:
    """One linear model per output dimension; the fit aggregates on the executors."""
    features = data.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    models = []
    for k in range(dims):
        lr = LinearRegression(regParam=ridge, solver="l-bfgs", maxIter=500, tol=1e-12, labelCol="label", featuresCol="features")
        models.append(lr.fit(features.withColumn("label", F.get("pose", F.lit(k)).cast("double"))))
    return models


def loss_by_step(data: DataFrame, models: list, step: str = "step") -> DataFrame:
    """Mean squared error over the pose dimensions, per step."""
    out = data.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    total = F.lit(0.0)
    for k, m in enumerate(models):
        out = m.setPredictionCol(f"_p{k}").transform(out)
        total = total + F.pow(F.col(f"_p{k}") - F.get("pose", F.lit(k)), 2)
    return out.groupBy(step).agg(F.avg(total / len(models)).alias("loss"), F.count(F.lit(1)).alias("samples"))
