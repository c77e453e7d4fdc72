"""Partitioned Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import SLICE_ROWS
from tidemark.sources.fixtures import GROUP


def write_partitioned(df: DataFrame, path: str, keys: list[str] = GROUP, seq: str = "seq", n_rows: int | None = None) -> None:
    """One directory a group, in which each slice of ``SLICE_ROWS`` of ``seq`` is in one file, so that no task writes a long day and a short one is not scattered over many files.

    With about ``n_rows`` rows there are as many tasks as these have slices, since rows may be wide; else the session's.
    """
    n = [] if n_rows is None else [max(1, -(-n_rows // SLICE_ROWS))]
    df.repartition(*n, *keys, F.floor((F.col(seq) - 1) / SLICE_ROWS)).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def with_top_columns(snaps: DataFrame) -> DataFrame:
    """Snapshots with their best prices beside the arrays, so that readers of the mid alone skip the arrays."""
    return snaps.withColumns({"b0": snaps["bid_px"][0], "a0": snaps["ask_px"][0]})
