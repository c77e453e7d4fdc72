"""Vendor feeds into the two tables that everything else reads: order messages and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_PRICE = 9223372036854775807
SCALE = 100_000  # from 1e-9 to 1e-4 units


def event_type() -> Column:
    """Add and modify 1, cancel 2, delete and clear 3, fill 4; trades and others null."""
    a = F.col("action")
    return F.when(a.isin("A", "M"), 1).when(a == "C", 2).when(a.isin("D", "R"), 3).when(a == "F", 4)


def rescaled(price: Column) -> Column:
    """1e-4 units, truncated; 0 for null, sentinel and negative prices."""
    known = price.isNotNull() & (price != NULL_PRICE) & (price > 0)
    return F.when(known, F.call_function("div", price, F.lit(SCALE))).otherwise(F.lit(0).cast("long"))


def orders(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Messages of known instruments that change a book; a non-null size under 0 is an error."""
    rows = raw.join(F.broadcast(instruments), "instrument_id").withColumn("event_type", event_type()).where("event_type is not null")
    rows = rows.withColumn("price", rescaled(F.col("price"))).where((F.col("event_type") != 1) | (F.col("price") > 0))
    size = F.when(F.col("size") < 0, F.raise_error(F.lit("negative size"))).otherwise(F.col("size"))
    return rows.select("ticker_id", "ticker", "seq", F.expr("ts_event div 1000").alias("ts_us"), "event_type", "order_id", size.alias("size"), "price", F.when(F.col("side").eqNullSafe("B"), 1).otherwise(-1).alias("direction"))


def quotes(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Top-of-book quotes with both sides known, positive after scaling, and not crossed."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != NULL_PRICE) & (F.col(c) > 0)
    rows = raw.join(F.broadcast(instruments), "instrument_id").where(known("bid_px") & known("ask_px"))
    rows = rows.withColumns({"bid_px": rescaled(F.col("bid_px")), "ask_px": rescaled(F.col("ask_px"))}).where("bid_px > 0 and ask_px > 0 and bid_px < ask_px")
    return rows.select("ticker_id", "ticker", F.col("seq").alias("tseq"), F.expr("ts_event div 1000").alias("ts_us"), "bid_px", "bid_sz", "ask_px", "ask_sz")


def level0(levels: DataFrame) -> DataFrame:
    """The first level of rows with an array ``levels`` of (bid_px, bid_sz, ask_px, ask_sz); empty arrays drop out."""
    first = F.col("levels")[0]
    rest = [c for c in levels.columns if c != "levels"]
    return levels.where(F.size("levels") > 0).select(*rest, *[first[c].alias(c) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")])
