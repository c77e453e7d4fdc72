"""Comparison of rebuilt books with reference quotes: gates, accuracy, tiers, suites, mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import asof, book
from tidemark.operators.materialise import cut
from tidemark.operators.ranks import scan
from tidemark.sources.fixtures import GROUP

SECOND = 1_000_000


def bounds(truth: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """First and last quote time of each group."""
    return truth.groupBy(*keys).agg(F.min("ts_us").alias("open_us"), F.max("ts_us").alias("close_us"))


def valid_time(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("ts_us") >= SECOND)


def session_gate(messages: DataFrame, truth: DataFrame, margin_us: int = 60 * SECOND, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """Messages from the margin before the first quote up to the first message beyond the margin after the last."""
    gated = valid_time(messages).join(F.broadcast(bounds(truth, keys)), keys).where(F.col("ts_us") >= F.col("open_us") - margin_us)
    return prefix_cut(gated, F.col("ts_us") > F.col("close_us") + margin_us, keys, n_rows=n_rows)


def prefix_cut(rows: DataFrame, beyond: Column, keys: list[str] = GROUP, seq: str = "seq", n_rows: int | None = None) -> DataFrame:
    """The rows before the first, in order, that ``beyond`` holds for; where it is null it doesn't.  ``rows`` are read twice."""
    return scan(rows, keys, seq, {"__over": ("max", F.coalesce(beyond, F.lit(False)).cast("int"))}, n_rows=n_rows).where("__over = 0").drop("__over")


def latch(rows: DataFrame, ready: Column, keys: list[str] = GROUP, seq: str = "seq", n_rows: int | None = None) -> DataFrame:
    """The rows from the first, in order, that ``ready`` holds for; where it is null it doesn't.  ``rows`` are read twice."""
    return scan(rows, keys, seq, {"__on": ("max", F.coalesce(ready, F.lit(False)).cast("int"))}, n_rows=n_rows).where("__on = 1").drop("__on")


def compared(snaps: DataFrame, truth: DataFrame, keys: list[str] = GROUP, in_order: bool = True, time: str = "ts_us", n_rows: int | None = None) -> DataFrame:
    """Each snapshot's best prices with those of the quote at its time (t_bid, t_ask, t_us, tseq).

    Validators of a running book compare at the message's time; those of a stored data set only have the
    time in the snapshot (``time="snap_us"``), which stays behind on messages that leave the book alone.  ``in_order`` the best
    prices are written first, since the running maximum of their times reads them twice.
    """
    quotes = truth.select(*keys, "tseq", "ts_us", F.col("ts_us").alias("t_us"), F.col("bid_px").alias("t_bid"), F.col("bid_sz").alias("t_bid_sz"), F.col("ask_px").alias("t_ask"), F.col("ask_sz").alias("t_ask_sz"))
    best = book.bbo(snaps, keys, time)
    return asof.asof(cut(best) if in_order else best, quotes, ["tseq", "t_us", "t_bid", "t_bid_sz", "t_ask", "t_ask_sz"], keys, in_order=in_order, n_rows=n_rows)


def hit() -> Column:
    return (F.col("bid_px") == F.col("t_bid")) & (F.col("ask_px") == F.col("t_ask"))


def accuracy(matched: Column, n: Column) -> Column:
    """Per cent, 0 where nothing was compared."""
    return F.coalesce(F.round(F.try_divide(matched * 100.0, n), 9), F.lit(0.0))


def group_accuracy(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """(keys, matched, failed, accuracy) of compared rows."""
    out = rows.groupBy(*keys).agg(F.count_if(hit()).alias("matched"), F.count_if(~hit()).alias("failed"))
    return out.withColumn("accuracy", accuracy(F.col("matched"), F.col("matched") + F.col("failed")))


def day_book(messages: DataFrame, truth: DataFrame, keys: list[str] = GROUP, slice_rows: int = book.SLICE_ROWS, n_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(snapshots, accuracy) of every day: gate, fold, match while the market is open, count."""
    snaps = book.snapshots(session_gate(messages, truth, keys=keys, n_rows=n_rows), keys, slice_rows, n_rows=n_rows)
    open_ = compared(snaps, truth, keys, n_rows=n_rows).join(F.broadcast(bounds(truth, keys)), keys).where("ts_us between open_us and close_us")
    return snaps, group_accuracy(open_, keys)


def tier(acc: Column, passes: float = 95.0, marginal: float = 90.0) -> Column:
    return F.when(acc >= passes, "PASS").when(acc >= marginal, "MARGINAL").otherwise("FAIL")


#: How the three suites count: are groups without quotes failures; do marginal ones pass; is the
#: missing part of the denominator; does it also forbid a pass; and the pass mark, a rate or a count.
POLICIES = {
    "all": {"empty_fails": True, "marginal_passes": True, "missing_counts": False, "missing_forbids": False, "rate": 90.0, "count": None},
    "four": {"empty_fails": False, "marginal_passes": False, "missing_counts": True, "missing_forbids": False, "rate": None, "count": 65},
    "final": {"empty_fails": True, "marginal_passes": True, "missing_counts": True, "missing_forbids": True, "rate": 90.0, "count": None},
}


def suite_summary(expected: DataFrame, orders: DataFrame, accuracies: DataFrame, policy: dict, passes: float = 95.0, marginal: float = 90.0, keys: list[str] = GROUP) -> DataFrame:
    """Per ticker and overall (null): total, passed, skipped, missing, failed, rate, verdict.

    ``expected`` are the groups asked for, ``orders`` those with messages, ``accuracies`` those with quotes.
    """
    rows = expected.join(orders.withColumn("there", F.lit(True)), keys, "left").join(accuracies.select(*keys, "accuracy"), keys, "left")
    state = F.when(F.col("there").isNull(), "MISSING").when(F.col("accuracy").isNull(), "EMPTY").otherwise(tier(F.col("accuracy"), passes, marginal))
    good = ["PASS", "MARGINAL"] if policy["marginal_passes"] else ["PASS"]
    skip = ["MISSING"] if policy["empty_fails"] else ["MISSING", "EMPTY"]
    rows = rows.select(keys[0], state.alias("state")).rollup(keys[0]).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state").isin(good)).alias("passed"),
        F.count_if(F.col("state").isin(skip)).alias("skipped"), F.count_if(F.col("state") == "MISSING").alias("missing"),
    )
    rows = rows.withColumn("failed", F.col("total") - F.col("passed") - F.col("skipped"))
    base = F.col("total") if policy["missing_counts"] else F.col("total") - F.col("skipped")
    rows = rows.withColumn("rate", F.round(F.try_divide(F.col("passed") * 100.0, base), 9))
    good_enough = F.col("passed") >= policy["count"] if policy["count"] is not None else F.coalesce(F.col("rate") >= policy["rate"], F.lit(False))
    if policy["missing_forbids"]:
        good_enough = good_enough & (F.col("missing") == 0)
    return rows.withColumn("verdict", F.when(good_enough, "PASS").otherwise("FAIL"))


def offline(snaps: DataFrame, truth: DataFrame, tolerance_us: int = 5000, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """Stored snapshots compared with the positive quotes, where these are near enough in time."""
    quotes = positive(truth)
    return gated(compared(snaps, quotes, keys, time="snap_us", n_rows=n_rows).where("t_bid is not null"), quotes, tolerance_us, keys=keys, n_rows=n_rows)


def gated(rows: DataFrame, truth: DataFrame, tolerance_us: int = 5000, margin_us: int = SECOND, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """Compared rows near enough to their quote, in the quotes' range widened by the margin."""
    near = rows.where(F.col("ts_us") >= SECOND).join(F.broadcast(bounds(truth, keys)), keys).where(F.col("ts_us") >= F.col("open_us") - margin_us)
    near = prefix_cut(cut(near), F.col("ts_us") > F.col("close_us") + margin_us, keys, n_rows=n_rows)
    return near.where(asof.within(F.col("ts_us") - F.col("t_us"), tolerance_us))


def positive(truth: DataFrame) -> DataFrame:
    return truth.where("bid_px > 0 and ask_px > 0")


def tolerance_accuracy(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """(keys, checked, matched, accuracy) of ``offline`` rows."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"), F.count_if(hit()).alias("matched"))
    return out.withColumn("accuracy", accuracy(F.col("matched"), F.col("checked")))


def truth_driven(snaps: DataFrame, truth: DataFrame, tolerance_us: int = 1000, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """Each quote with the stored snapshot at its time, by the snapshots' own times, where that is nearer than the tolerance."""
    books = cut(book.bbo(snaps, keys, "snap_us")).select(*keys, "seq", "ts_us", F.col("ts_us").alias("s_us"), F.col("bid_px").alias("s_bid"), F.col("ask_px").alias("s_ask"))
    out = asof.asof(truth, books, ["seq", "s_us", "s_bid", "s_ask"], keys, left_seq="tseq", right_seq="seq", in_order=True, n_rows=n_rows)
    return out.where(asof.within(F.col("ts_us") - F.col("s_us"), tolerance_us)).withColumn("hit", (F.col("bid_px") == F.col("s_bid")) & (F.col("ask_px") == F.col("s_ask")))


def mismatch_breakdown(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Which side is wrong, in which direction, and the shares of the mismatches."""
    bid, ask = F.col("bid_px") == F.col("t_bid"), F.col("ask_px") == F.col("t_ask")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(bid & ask).alias("matched"), F.count_if(~bid & ask).alias("bid_only"), F.count_if(bid & ~ask).alias("ask_only"), F.count_if(~bid & ~ask).alias("both"),
        F.count_if(F.col("bid_px") > F.col("t_bid")).alias("bid_high"), F.count_if(F.col("bid_px") < F.col("t_bid")).alias("bid_low"),
        F.count_if(F.col("ask_px") > F.col("t_ask")).alias("ask_high"), F.count_if(F.col("ask_px") < F.col("t_ask")).alias("ask_low"),
    )
    failed = F.col("checked") - F.col("matched")
    share = {f"{c}_share": F.round(F.try_divide(F.col(c) * 100.0, failed), 9) for c in ("bid_only", "ask_only", "both")}
    return out.withColumns(share)


def first_mismatches(rows: DataFrame, n: int = 20, keys: list[str] = GROUP) -> DataFrame:
    """The first n mismatches of each group with their signed differences."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("seq")).cast("long")
    bad = rows.where(~hit()).withColumn("place", place).where(F.col("place") <= n)
    return bad.select(*keys, "place", "seq", "bid_px", "ask_px", "t_bid", "t_ask", (F.col("bid_px") - F.col("t_bid")).alias("bid_delta"), (F.col("ask_px") - F.col("t_ask")).alias("ask_delta"))


def running_accuracy(rows: DataFrame, every: int = 50_000, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """Cumulative accuracy and tier at every n-th compared row."""
    marked = cut(rows.select(*keys, "seq", F.coalesce(hit(), F.lit(False)).cast("long").alias("hit")))
    out = scan(marked, keys, "seq", {"processed": ("sum", F.lit(1).cast("long")), "matched": ("sum", F.col("hit"))}, n_rows=n_rows)
    out = out.where(F.col("processed") % every == 0).withColumn("accuracy", accuracy(F.col("matched"), F.col("processed")))
    return out.select(*keys, "seq", "processed", "matched", "accuracy", tier(F.col("accuracy"), 98.0, 90.0).alias("tier"))


def timestamp_counts(snaps: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Stored snapshots, and those whose own time is over 1 s."""
    return snaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("snap_us") > SECOND).alias("valid"))
