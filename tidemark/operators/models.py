"""Classifier training, batch scoring and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import datasets


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy_recall(preds: DataFrame, classes: list[int]) -> DataFrame:
    """One row: n, accuracy and the recall of each class, 0 for an absent one."""
    recall = lambda c: F.coalesce(F.try_divide(F.count_if((F.col("label") == c) & (F.col("pred") == c)), F.count_if(F.col("label") == c)), F.lit(0.0))
    hit = F.try_divide(F.count_if(F.col("label") == F.col("pred")), F.count(F.lit(1)))
    return preds.agg(F.count(F.lit(1)).alias("n"), F.round(hit, 9).alias("accuracy"), *[F.round(recall(c), 9).alias(f"recall_{c}") for c in classes])


def log_loss(p: Column) -> Column:
    """Loss of the probability given to the right class."""
    return -F.log(F.greatest(p, F.lit(1e-12)))


def mean_loss(rows: DataFrame, loss: Column, day: str) -> DataFrame:
    """Loss by day, and the row-weighted mean of all days (null day)."""
    return rows.withColumn("__loss", loss).rollup(day).agg(F.count(F.lit(1)).alias("n"), F.avg("__loss").alias("loss"))


def summarised(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Each window as one vector: the last row's features and the means over the window's rows."""
    from pyspark.ml.functions import array_to_vector

    width = F.size(F.col("x")[0])
    last = F.element_at("x", -1)
    mean = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.aggregate("x", F.lit(0.0), lambda s, r: s + F.get(r, k)) / F.size("x"))
    return windows.select(*keys, "window", "y", array_to_vector(F.concat(last, mean)).alias("features"))


def train(windows: DataFrame, max_iter: int = 20):
    """Multinomial logistic regression with inverse-frequency row weights; ``windows`` has features and y."""
    from pyspark.ml.classification import LogisticRegression

    weighted = datasets.sample_weights(windows.withColumn("label", F.col("y").cast("double")))
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, regParam=1e-3).fit(weighted)


def scored(model, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window, label, pred, loss) of windows under a fitted model."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(windows)
    p = vector_to_array("probability")
    return out.select(*keys, "window", F.col("y").alias("label"), F.col("prediction").cast("int").alias("pred"), log_loss(F.get(p, F.col("y"))).alias("loss"))


def batch_scored(rows: DataFrame, make_model: Callable, column: str, width: int, out: str = "score", batch: int = 1024) -> DataFrame:
    """Score an array column of ``width`` numbers with a model of the caller's: ``make_model()`` runs once a worker and returns numpy to numpy."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    udf = predict_batch_udf(make_model, return_type=T.DoubleType(), batch_size=batch, input_tensor_shapes=[[width]])
    return rows.withColumn(out, udf(F.col(column)))


def window_scorer(model, size: int, label: int) -> Callable:
    """For ``batch_scored``: what a fitted model gives for the chance of ``label`` of windows of ``size`` rows, laid end to end, without Spark."""
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def make_model():
        import numpy as np

        def score(x):
            rows = np.asarray(x, float).reshape(len(x), size, -1)
            z = np.concatenate([rows[:, -1], rows.mean(axis=1)], axis=1) @ weights.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            return p[:, label] / p.sum(axis=1)

        return score

    return make_model


def map_groups(rows: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """User code over whole groups, Arrow table to Arrow table; each group must fit one task."""
    return rows.groupBy(*keys).applyInArrow(fn, schema)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append result rows to a metrics table."""
    df.withColumn("recorded", F.current_timestamp()).write.mode("append").parquet(path)
