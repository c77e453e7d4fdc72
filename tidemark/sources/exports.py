"""Vendor feeds exported to CSV or Parquet, with the columns that ``operators.normalise`` reads.

The exports name the place of a message ``sequence`` and the top of book ``bid_px_00``, ``bid_sz_00``,
``ask_px_00``, ``ask_sz_00``; prices are integers of 1e-9, with the greatest 64-bit integer for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MBO = "ts_event long, instrument_id int, action string, side string, price long, size int, order_id long, sequence long"
MBP = "ts_event long, instrument_id int, sequence long, bid_px_00 long, bid_sz_00 int, ask_px_00 long, ask_sz_00 int"


def _read(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)  # by header: the files may have further columns
        return raw.select(*[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in schema.split(", "))])
    return spark.read.format(kind).load(path).select(*names)


def read_mbo(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Raw messages, as ``normalise.orders`` takes them."""
    return _read(spark, path, MBO, kind).withColumnRenamed("sequence", "seq")


def read_mbp(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Raw top-of-book quotes, as ``normalise.quotes`` takes them."""
    raw = _read(spark, path, MBP, kind)
    return raw.select("ts_event", "instrument_id", F.col("sequence").alias("seq"), *[F.col(f"{c}_00").alias(c) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")])
