"""Manifests, counts, rates and size reports, sorted by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.fixtures import GROUP


def manifest_missing(expected: DataFrame, present: dict[str, DataFrame], keys: list[str] = GROUP) -> DataFrame:
    """Expected groups with the rows of each kind, those that lack one or more kinds."""
    rows = expected
    for kind, df in present.items():
        rows = rows.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(kind)), keys, "left")
    absent = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in present]))
    rows = rows.withColumn("missing", F.array_join(absent, ",")).where("missing <> ''")
    return rows.select(*keys, *[F.coalesce(k, F.lit(0)).alias(k) for k in present], "missing").orderBy(*keys)


def counts_rollup(kinds: dict[str, DataFrame], keys: list[str] = GROUP) -> DataFrame:
    """Rows of each kind by ticker and day, by ticker, and overall."""
    names = list(kinds)
    rows = None
    for kind, df in kinds.items():
        one = df.select(*keys, F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.unionByName(one)
    counted = rows.groupBy(*keys).pivot("kind", names).count()
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in names]
    return counted.rollup(*keys).agg(*sums).orderBy(*keys)


def duration_rate(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Rows, seconds, mean rate, the rows of one second at it and the seconds of 5,000 rows."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"))
    rate = F.try_divide(F.col("n") * 1e6, F.col("span_us"))
    return out.select(*keys, "n", "span_us", F.round(rate, 9).alias("rate"), F.floor(rate).alias("rows_1s"), F.round(F.try_divide(F.lit(5000.0), rate), 6).alias("seconds_5000")).orderBy(*keys)


def rate_buckets(rows: DataFrame, seconds: int = 1800, keys: list[str] = GROUP) -> DataFrame:
    """Rows and rate by bucket counted from the group's first row; empty buckets are left out."""
    first = F.min("ts_us").over(W.partitionBy(*keys))
    bucket = F.call_function("div", F.col("ts_us") - F.col("first"), F.lit(seconds * 1_000_000))
    out = rows.select(*keys, "ts_us", first.alias("first")).groupBy(*keys, "first", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    start = F.timestamp_micros(F.col("first") + F.col("bucket") * seconds * 1_000_000)
    return out.select(*keys, "bucket", "n", F.round(F.col("n") / float(seconds), 9).alias("rate"), F.date_format(start, "HH:mm").alias("starts")).orderBy(*keys, "bucket")


def dataset_size(rows: DataFrame, stride: int = 4, size: int = 100, width: int = 40, keys: list[str] = GROUP) -> DataFrame:
    """Rows, windows, bytes of float windows and what memory they ask for."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("windows", F.call_function("div", F.col("n"), F.lit(stride)))
    out = out.withColumn("bytes", F.col("windows") * size * width * 4)
    return out.withColumn("fits", F.when(F.col("bytes") <= 12_000_000_000, "memory").when(F.col("bytes") <= 32_000_000_000, "half").otherwise("stream")).orderBy(*keys)


def readiness(rows: DataFrame, expected: DataFrame, least: int = 10_000, keys: list[str] = GROUP) -> DataFrame:
    """Each expected group with its rows and whether they suffice."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = expected.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("ready", F.col("n") > least).orderBy(*keys)


def preflight(features: DataFrame, labelled: DataFrame, expected: DataFrame, width: int = 40, least: int = 10_000, least_labels: int = 1_000, keys: list[str] = GROUP) -> DataFrame:
    """Each expected group with what training asks of it: rows, feature rows of another length or with a null, valid labels, verdict.

    ``features`` has an array column x of doubles, ``labelled`` a label, -1 where it is invalid.
    """
    if dict(features.dtypes).get("x") not in ("array<double>", "array<float>") or "label" not in labelled.columns:
        raise ValueError("features need an array x of numbers, labelled rows a label")
    bad = (F.size("x") != width) | F.exists("x", lambda v: v.isNull())
    shape = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("misshapen"))
    valid = labelled.groupBy(*keys).agg(F.count_if(F.col("label") != -1).alias("labels"))
    out = expected.join(shape, keys, "left").join(valid, keys, "left")
    out = out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "misshapen", "labels")])
    reason = F.when(F.col("n") == 0, "missing").when(F.col("n") <= least, "rows").when(F.col("misshapen") > 0, "shape").when(F.col("labels") <= least_labels, "labels").otherwise("ready")
    return out.withColumn("verdict", reason).orderBy(*keys)
