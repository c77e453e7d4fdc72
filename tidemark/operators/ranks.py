"""Numbers and running values in order, without a task that holds a whole group or table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.materialise import cut, staged

SLICE_ROWS, PART_ROWS = 100_000, 500_000


def parts(df: DataFrame, rows: int | None) -> list[int]:
    """A number of partitions to deal ``rows`` to, where those of the session would have more than ``PART_ROWS`` each; else none.

    Adaptive execution joins the session's partitions until there are no more than cores, however many rows each has then, so no
    more of them than cores count.  A number that is given stays.
    """
    n, spark = -(-(rows or 0) // PART_ROWS), df.sparkSession
    return [n] if n > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else []


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to as many tasks as ``parts`` says; as it is where the session's partitions do."""
    n = parts(df, rows)
    return df.repartition(*n, *keys) if n else df


def placed(df: DataFrame, order: list[str], given: int | None = None) -> DataFrame:
    """Rows in a total order, ``__part`` by ``__part``, and by ``__row`` within one.

    They are materialised, since Spark may cut the ranges elsewhere when it runs again: whatever is counted by part
    and the rows that it is added to come from one table.  With their number ``given`` no task gets many more than ``PART_ROWS``,
    and they stay as Parquet while the driver runs.
    """
    rows = df.repartitionByRange(*parts(df, given), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    rows = rows.withColumn("__row", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33))
    return cut(rows) if given is None else staged(rows, "placed")


def before_part(rows: DataFrame, total: Column) -> Column:
    """What the parts before a row's own hold of ``total``; only one number a part reaches the driver."""
    sums = dict(rows.groupBy("__part").agg(total).collect())
    found = np.array([sums.get(i, 0) for i in range(max(sums, default=0) + 1)], np.int64)
    return F.lit(np.append(0, np.cumsum(found)[:-1]))[F.col("__part")]


def with_index(df: DataFrame, order: list[str], name: str = "index", rows: int | None = None) -> DataFrame:
    """A gapless row index in a total order: a range sort, one count a partition, no single-task window."""
    rows = placed(df, order, rows)
    return rows.withColumn(name, (before_part(rows, F.count(F.lit(1))) + F.col("__row")).cast("long")).drop("__part", "__row")


def with_total(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """The running total of an integer column in a total order, own row included, in the same way."""
    rows = placed(df, order)
    run = F.sum(column).over(W.partitionBy("__part").orderBy("__row").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, (before_part(rows, F.sum(column)) + run).cast("long")).drop("__part", "__row")


#: How a slice is summed up, and how sums of slices and rows run on.
FOLDS = {
    "max": (lambda value, at: F.max(value), F.max),
    "sum": (lambda value, at: F.sum(value), F.sum),
    "last": (lambda value, at: F.max_by(value, F.when(value.isNotNull(), at)), lambda value: F.last(value, ignorenulls=True)),
}


def scan(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], slice_rows: int = SLICE_ROWS, n_rows: int | None = None) -> DataFrame:
    """``df`` with running values of each group in the order of an integer column, own row included.

    ``values`` names for each new column how it runs (``max``, ``sum`` or ``last``, the last that isn't null) and over what.
    A group is cut into slices of ``slice_rows`` of ``order``; every slice is summed up, the sums run on from slice to slice, and each slice opens
    with those of the slices before it, as a row that goes before its own.  So a long day is spread over as many tasks as it
    has slices, and only one row a slice passes through a window of the whole group.  ``df`` is read twice.
    Nulls add nothing to a running value, which is null before the first; rows whose ``order`` is null come first.  Rows that tie in ``order``
    have any order among themselves.  With about ``n_rows`` rows no task gets many more than ``PART_ROWS``.
    """
    names = df.columns
    rows = df.withColumn("__slice", F.floor(F.col(order) / slice_rows)).withColumns({f"__in_{n}": value for n, (_, value) in values.items()})
    ends = rows.groupBy(*keys, "__slice").agg(*[FOLDS[kind][0](F.col(f"__in_{n}"), F.col(order)).alias(f"__in_{n}") for n, (kind, _) in values.items()])
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    opening = ends.select(*keys, "__slice", F.lit(0).alias("__side"), *[FOLDS[kind][1](F.col(f"__in_{n}")).over(before).alias(f"__in_{n}") for n, (kind, _) in values.items()])
    both = rows.withColumn("__side", F.lit(1)).unionByName(opening, allowMissingColumns=True)
    both = dealt(both, n_rows, *keys, "__slice")
    run = W.partitionBy(*keys, "__slice").orderBy("__side", order).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({f"__out_{n}": FOLDS[kind][1](F.col(f"__in_{n}")).over(run) for n, (kind, _) in values.items()}).where("__side = 1")
    return both.select(*[c for c in names if c not in values], *[F.col(f"__out_{n}").alias(n) for n in values])
