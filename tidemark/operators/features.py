"""Depth features, rolling z-scores, inter-arrival times and sliding windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import folds
from tidemark.operators.ranks import SLICE_ROWS, scan
from tidemark.sources.fixtures import GROUP

DEPTH = 10
WIDTH = 4 * DEPTH
WINDOW, STRIDE = 100, 4


def integer_features() -> Column:
    """ask_px, bid_px, ask_sz, bid_sz of each of the ten levels in turn, as stored (prices in 1e-4 units); null where there is none."""
    names = ("ask_px", "bid_px", "ask_sz", "bid_sz")
    return F.array(*[F.get(F.col(c), F.lit(i)).cast("long") for i in range(DEPTH) for c in names])


def scaled(features: Column) -> Column:
    """Prices in price units; sizes as they are."""
    return F.transform(features, lambda x, i: F.when(i % 4 < 2, x / 10_000.0).otherwise(x.cast("double")))


def features40(snaps: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    return snaps.select(*keys, "seq", "ts_us", scaled(integer_features()).alias("x"))


def flattened(snaps: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """One column for the time and each of the forty values, in price units."""
    cols = [(F.col(c)[i] / (10_000.0 if c.endswith("px") else 1.0)).alias(f"{c}_{i}") for c in ("bid_px", "bid_sz", "ask_px", "ask_sz") for i in range(DEPTH)]
    return snaps.select(*keys, "seq", (F.col("ts_us") / 1e6).alias("time"), *cols)


def zscore(snaps: DataFrame, size: int = WINDOW, causal: bool = False, keys: list[str] = GROUP, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each feature less its rolling mean over its rolling deviation, variance 1e-8 at least.

    The frame is rows i - size/2 .. i + size - size/2 - 1, or the last ``size`` rows if ``causal``; beyond the ends
    the first and last rows repeat.  Sums are running sums of integers less a slice's first row, in one
    streamed pass, so the frame's width costs nothing and no digits cancel.  A group is numbered by a scan and cut into slices of ``slice_rows``,
    each with the rows that its frames reach, so that a day is spread over tasks.  A null feature has a null z-score and no part in those of others.
    """
    back = size - 1 if causal else size // 2
    ahead, unit = size - 1 - back, np.where(np.arange(WIDTH) % 4 < 2, 10_000.0, 1.0)
    raw = scan(snaps.select(*keys, "seq", "ts_us", integer_features().alias("f")), keys, "seq", {"__i": ("sum", F.lit(1).cast("long"))})
    dealt = folds.halo(raw, F.col("__i") - 1, slice_rows, back, ahead)
    return folds.folded(dealt, keys, ["__i"], lambda: folds.Rolling("f", unit, back, ahead), [("z", T.ArrayType(T.DoubleType()))], ["f", "__i"])


def interarrival(rows: DataFrame, keys: list[str], order: list[str] = ["ts_us", "seq"]) -> DataFrame:
    """``gap``: the time since the row before, 0 for the first, over the greatest of its group plus 1e-8 s; times in microseconds."""
    group = W.partitionBy(*keys)
    gap = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(group.orderBy(*order))) / 1e6, F.lit(0.0))
    return rows.withColumn("__gap", gap).withColumn("gap", F.col("__gap") / (F.max("__gap").over(group) + 1e-8)).drop("__gap")


def sliding_windows(rows: DataFrame, columns: list[str], size: int = WINDOW, stride: int = STRIDE, label: str | None = None, keys: list[str] = GROUP) -> DataFrame:
    """(keys, window, x, y): rows ``columns`` of ``size`` consecutive rows, each ``stride`` rows, in order; y labels the last.

    Windows end at rows size-1, size-1+stride, ...; each row goes straight to the windows that hold it,
    so only rows of wanted windows are shuffled.
    """
    order = W.partitionBy(*keys).orderBy("seq")
    at = rows.withColumn("__i", F.row_number().over(order).cast("long") - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - (size - 1)) / stride))
    last = F.least(F.floor(F.col("__i") / stride), F.floor((F.col("__n") - size) / stride))
    held = at.where((F.col("__n") >= size) & (first <= last)).withColumn("window", F.explode(F.sequence(first, last)))
    row = F.struct((F.col("__i") - F.col("window") * stride).alias("pos"), *columns, *([label] if label else []))
    out = held.groupBy(*keys, "window").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    x = F.transform("rows", lambda r: r[columns[0]] if len(columns) == 1 else F.struct(*[r[c].alias(c) for c in columns]))
    y = [F.element_at("rows", -1)[label].alias("y")] if label else []
    return out.select(*keys, "window", x.alias("x"), *y)
