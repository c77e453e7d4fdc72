"""Backward as-of matching of two ordered tables by key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import SLICE_ROWS, dealt, parts, scan
from tidemark.sources.fixtures import GROUP

HALF_HOUR = 1_800_000_000


def monotone(df: DataFrame, keys: list[str], time: str, seq: str, n_rows: int | None = None) -> DataFrame:
    """Time that never moves back in file order: the running maximum.  ``df`` is read twice."""
    return scan(df, keys, seq, {time: ("max", F.col(time))}, n_rows=n_rows).select(*df.columns)


def width(left: DataFrame, right: DataFrame, keys: list[str], time: str, bucket_us: int, rows: int = SLICE_ROWS) -> int:
    """``bucket_us``, halved until its fullest bucket would have about ``rows`` rows if they come evenly."""
    both = left.select(*keys, time).unionByName(right.select(*keys, time))
    most = both.groupBy(*keys, F.floor(F.col(time) / bucket_us)).count().agg(F.max("count")).first()[0] or 0
    return max(1, bucket_us >> max(0, math.ceil(math.log2(max(1, most) / rows))))


def asof(left: DataFrame, right: DataFrame, columns: list[str], keys: list[str] = GROUP, time: str = "ts_us", left_seq: str = "seq", right_seq: str = "tseq", clamp: bool = True, in_order: bool = False, bucket_us: int = HALF_HOUR, n_rows: int | None = None) -> DataFrame:
    """Every left row with ``columns`` of the last right row of its key at or before its time.

    Of right rows at one time the last in file order counts.  Before the first right row the first
    one is taken with ``clamp``, else nulls.  Keys without right rows get nulls.  ``in_order`` makes
    times monotone on both sides first.

    One sort of both tables by key, time bucket and time; no range join.  Each bucket of ``bucket_us`` opens
    with the last right row of the bucket before it, so that a long day is spread over tasks.  Left rows
    outside the buckets of the right table count to its first or last one, and those in a gap between two of its buckets to
    the bucket before the gap, so that a gap costs nothing, however long.  The right table is read three times, both tables twice as often ``in_order``.
    With about ``n_rows`` rows on the left, where these are more than the session's partitions should hold, buckets are as narrow as the fullest one needs.
    What is known of a key, one row, is broadcast, so that rows of a key needn't meet for it.
    """
    if parts(left, n_rows):
        bucket_us = width(left, right, keys, time, bucket_us)
    if in_order:
        left, right = monotone(left, keys, time, left_seq, n_rows), monotone(right, keys, time, right_seq, n_rows)
    bucket = F.floor(F.col(time) / bucket_us)
    quotes = right.select(*keys, F.col(time).alias("__t"), F.col(right_seq).alias("__seq"), bucket.alias("__bucket"), F.struct(*columns).alias("__right"))
    order = F.struct("__t", "__seq")
    ends = quotes.groupBy(*keys, "__bucket").agg(F.max_by("__right", order).alias("__last"), F.min_by("__right", order).alias("__first"))
    ends = ends.withColumn("__next", F.lead("__bucket").over(W.partitionBy(*keys).orderBy("__bucket")))
    gap = F.when(F.col("__next") > F.col("__bucket") + 1, F.struct(F.col("__bucket").alias("from"), F.col("__next").alias("to")))
    span = ends.groupBy(*keys).agg(F.min("__bucket").alias("__lo"), F.max("__bucket").alias("__hi"), F.min_by("__first", "__bucket").alias("__first"), F.collect_list(gap).alias("__gaps"))
    carried = ends.where("__next is not null").select(*keys, F.col("__next").alias("__bucket"), F.col("__last").alias("__right"))
    if clamp:
        carried = carried.unionByName(span.select(*keys, F.col("__lo").alias("__bucket"), F.col("__first").alias("__right")))
    none = F.lit(None).cast("long")
    carried = carried.select(*keys, "__bucket", none.alias("__t"), F.lit(0).alias("__side"), none.alias("__seq"), "__right")  # a null time sorts first
    in_gap = F.filter("__gaps", lambda g: (g["from"] < bucket) & (bucket < g["to"]))
    place = F.greatest("__lo", F.least("__hi", F.coalesce(F.get(in_gap, F.lit(0))["from"], bucket)))
    rows = left.select(*keys, F.struct(*left.columns).alias("__left"), time, F.col(left_seq).alias("__seq"))
    rows = rows.join(F.broadcast(span.drop("__first")), keys, "left").select(*keys, place.alias("__bucket"), F.col(time).alias("__t"), F.lit(1).alias("__side"), "__seq", "__left")
    both = rows.unionByName(quotes.withColumn("__side", F.lit(0)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    both = dealt(both, n_rows, *keys, "__bucket")
    run = W.partitionBy(*keys, "__bucket").orderBy("__t", "__side", "__seq").rowsBetween(W.unboundedPreceding, 0)
    matched = both.withColumn("__hit", F.last("__right", ignorenulls=True).over(run)).where("__side = 1")
    return matched.select("__left.*", "__hit.*")


def within(gap: Column, tolerance_us: int) -> Column:
    """Strictly nearer than the tolerance."""
    return F.abs(gap) < tolerance_us
