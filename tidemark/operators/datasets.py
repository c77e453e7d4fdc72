"""Splits, class weights, balanced samples and the composite data sets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import features, labels
from tidemark.operators.ranks import with_index
from tidemark.sources.fixtures import GROUP


def chronological_split(rows: DataFrame, validation: float = 0.2, order: list[str] | None = None) -> DataFrame:
    """``part``: the first int(n x (1 - validation)) rows train, the rest valid."""
    indexed = with_index(rows, order or [*GROUP, "seq"])
    cut = int(indexed.count() * (1 - validation))
    return indexed.withColumn("part", F.when(F.col("index") < cut, "train").otherwise("valid"))


def holdout_day(rows: DataFrame, least: int, keys: list[str] = GROUP) -> DataFrame:
    """``part`` by day: of each ticker's days with ``least`` rows the last is valid, the others train."""
    days = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    last = F.dense_rank().over(W.partitionBy(keys[0]).orderBy(F.desc(keys[1]))) == 1
    return days.withColumn("part", F.when(last, "valid").otherwise("train"))


def split_membership(rows: DataFrame, calendar: DataFrame, split: str) -> DataFrame:
    return rows.join(F.broadcast(calendar.where(F.col("split") == split)), "day_id", "left_semi")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight, normalised): 1 / (share + 1e-8), and the same scaled to sum to the number of classes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()  # one row a class
    counts = counts.withColumn("weight", 1.0 / (F.col("n") / F.sum("n").over(every) + 1e-8))
    return counts.withColumn("normalised", F.col("weight") / F.sum("weight").over(every) * F.count(F.lit(1)).over(every))


def sample_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(F.broadcast(class_weights(rows, label).select(label, "weight")), label)


def balanced_sample(rows: DataFrame, draws: int, order: list[str], seed: int = 7, label: str = "label") -> DataFrame:
    """``draws`` rows with replacement, classes equally likely: a class by one seeded uniform, a rank in it by another.

    Ranks come from ``with_index`` over (label, order), so no class passes through one task.
    """
    spark = rows.sparkSession
    indexed = with_index(rows, [label, *order])
    classes = indexed.groupBy(label).agg(F.min("index").alias("first"), F.count(F.lit(1)).alias("n"))
    weighted = classes.join(class_weights(indexed, label).select(label, "weight"), label).withColumn("chance", F.col("weight") * F.col("n"))
    upto = F.sum("chance").over(W.orderBy(label)) / F.sum("chance").over(W.partitionBy())
    bounds = weighted.withColumn("hi", upto).withColumn("lo", F.coalesce(F.lag(upto).over(W.orderBy(label)), F.lit(0.0)))
    digits = lambda salt: F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(salt), "id").cast("binary")), 1, 10)
    point = lambda salt: F.conv(digits(salt), 16, 10).cast("double") / float(1 << 40)
    drawn = spark.range(draws).select(F.col("id").alias("draw"), point(1).alias("u"), point(2).alias("v"))
    drawn = drawn.join(F.broadcast(bounds), (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | (F.col("hi") >= 1.0)))
    drawn = drawn.select("draw", (F.col("first") + F.floor(F.col("v") * F.col("n"))).alias("index"))
    return drawn.join(indexed, "index").drop("index")


def poisson_sample(rows: DataFrame, seed: int = 7, label: str = "label") -> DataFrame:
    """The cheap form: every row appears a Poisson number of times, on average as often as balance asks; no shuffle of rows.

    The number is a sum of Poisson draws, one of mean 1 for each unit of the mean and one for its fraction, so
    that neither the terms nor exp run out, however rare the class.
    """
    w = class_weights(rows, label)
    mean = F.broadcast(w.select(label, (F.sum("n").over(W.partitionBy()) / F.count(F.lit(1)).over(W.partitionBy()) / F.col("n")).alias("__mean")))
    marked = rows.join(mean, label).withColumn("__u", F.rand(seed)).withColumn("__whole", F.floor("__mean")).withColumn("__rest", F.col("__mean") - F.col("__whole"))
    terms = F.sequence(F.lit(0), F.lit(40))
    drawn = F.aggregate(terms, F.struct(F.lit(0).alias("k"), F.exp(-F.col("__rest")).alias("p"), F.exp(-F.col("__rest")).alias("c")),
        lambda s, i: F.when(s.c < F.col("__u"), F.struct((s.k + 1).alias("k"), (s.p * F.col("__rest") / (s.k + 1)).alias("p"), (s.c + s.p * F.col("__rest") / (s.k + 1)).alias("c"))).otherwise(s))["k"]
    upto = F.array(*[F.lit(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(20)])
    point = lambda i: F.pmod(F.xxhash64("__u", i), F.lit(1 << 52)) / float(1 << 52)
    units = F.when(F.col("__whole") > 0, F.sequence(F.lit(1).cast("long"), F.col("__whole"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.aggregate(units, drawn, lambda k, i: k + F.size(F.filter(upto, lambda c: c < point(i))))
    return marked.withColumn("__k", copies).where("__k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__k")))).drop("__mean", "__whole", "__rest", "__u", "__k")


def epoch_order(days: DataFrame, epochs: int, seed: int = 7) -> DataFrame:
    """(epoch, place, keys): the days in another order each epoch, by a hash."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "epoch", *[F.col(c).cast("string") for c in days.columns]).cast("binary"))
    each = days.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("place", F.row_number().over(W.partitionBy("epoch").orderBy(key)).cast("long"))


def save_thresholds(alphas: DataFrame, path: str) -> None:
    alphas.coalesce(1).write.mode("overwrite").parquet(path)


def load_thresholds(spark: SparkSession, path: str, columns: list[str]) -> DataFrame | None:
    """The stored thresholds, or None where there are none or their columns are others: fit again then."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return None
    return stored.select(*columns) if set(columns) <= set(stored.columns) else None


def fitted_thresholds(spark: SparkSession, path: str, fit: Callable[[], DataFrame]) -> DataFrame:
    """The stored thresholds; fitted and stored where there are none, or where their columns aren't those of ``fit``."""
    wanted = fit()  # a plan, not yet run
    stored = load_thresholds(spark, path, wanted.columns)
    if stored is None:
        save_thresholds(wanted, path)
        stored = spark.read.parquet(path)
    return stored


def labelled_features(snaps: DataFrame, alphas: DataFrame, horizon_us: int, z_size: int, least: int, keys: list[str] = GROUP) -> DataFrame:
    """(keys, seq, ts_us, z, label): session rows, labels and z-scores; invalid labels go after the z-score."""
    rows = labels.large_enough(labels.session_filter(snaps), least, keys)
    marked = labels.label_fixed(labels.forward_return(rows, horizon_us, keys), alphas).select(*keys, "seq", "label")
    z = features.zscore(rows, z_size, keys=keys)
    return labels.large_enough(z.join(marked, [*keys, "seq"]).where(F.col("label") != labels.INVALID), least, keys)


def windows_dataset(snaps: DataFrame, alphas: DataFrame, horizon_us: int = labels.HORIZON_US, z_size: int = 100, size: int = features.WINDOW, stride: int = features.STRIDE, least: int = 200, keys: list[str] = GROUP) -> DataFrame:
    """(keys, window, x, y): windows of z-scores over valid rows, labelled by their last row."""
    return features.sliding_windows(labelled_features(snaps, alphas, horizon_us, z_size, least, keys), ["z"], size, stride, "label", keys)


def concatenated(rows: DataFrame, calendar: DataFrame, path: str) -> None:
    """Rows with their split, written by ticker and split."""
    rows.join(F.broadcast(calendar), "day_id").write.mode("overwrite").partitionBy("ticker_id", "split").parquet(path)
