"""Session filter, forward returns, thresholds and labels on top-of-book snapshots (b0, a0 in 1e-4 units)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import folds
from tidemark.operators.ranks import with_total
from tidemark.sources.fixtures import GROUP

HORIZON_US = 100_000
SLICE_US = 600_000_000
SESSION = (34_200, 57_600)
DOWN, FLAT, UP, INVALID = 0, 1, 2, -1


def slice_width(reach_us: int, slice_us: int | None) -> int:
    """``slice_us``, or slices so long that the rows which they share with their neighbours are few."""
    return slice_us or max(SLICE_US, 4 * reach_us)


def session_filter(rows: DataFrame, tz: str | None = None) -> DataFrame:
    """Rows from 09:30 to before 16:00 at UTC-5, or in the time zone ``tz``."""
    if tz is None:
        second = F.pmod(F.floor(F.col("ts_us") / 1_000_000) - 18_000, F.lit(86_400))
    else:
        local = F.from_utc_timestamp(F.timestamp_micros("ts_us"), tz)
        second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return rows.where((second >= SESSION[0]) & (second < SESSION[1]))


def mid2() -> Column:
    """Twice the mid price, an integer."""
    return F.col("b0") + F.col("a0")


def mid_price() -> Column:
    return mid2() / 20_000.0


def relative_spread() -> Column:
    mid = mid_price()
    return (F.col("a0") - F.col("b0")) / 10_000.0 / F.when(mid > 0, mid).otherwise(1.0)


def large_enough(rows: DataFrame, least: int, keys: list[str] = GROUP) -> DataFrame:
    """Rows of groups of ``least`` rows at least."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def forward_return(rows: DataFrame, horizon_us: int = HORIZON_US, keys: list[str] = GROUP, slice_us: int | None = None) -> DataFrame:
    """``ret``: the mean mid in [t + H, t + 2H) over the mid now, less 1; null without such rows, a time or a mid.

    Sums run on integers in one streamed pass, so the horizon costs nothing, and one division ends it.  A group is cut into slices of
    ``slice_us``, each with the rows that its last ones look ahead to.  Rows without a mid aren't part of a mean.
    """
    ahead = lambda: folds.Ahead("ts_us", "__m", horizon_us, 2 * horizon_us)
    dealt = folds.halo(rows.withColumn("__m", mid2().cast("long")), F.col("ts_us"), slice_width(2 * horizon_us, slice_us), 0, 2 * horizon_us)
    rows = folds.folded(dealt, keys, ["ts_us", "seq"], ahead, [("__s", T.LongType()), ("__c", T.LongType())], ["__m"])
    base = F.col("__c") * mid2()
    ret = F.when((F.col("__c") > 0) & (mid2() > 0), (F.col("__s") - base) / base)
    return rows.withColumn("ret", ret).drop("__s", "__c")


def asymmetry(down: Column, up: Column, mean_abs: Column) -> Column:
    return F.abs(down - up) / mean_abs


def quantiles(values: DataFrame, column: str, points: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, p, value, n): exact interpolated percentiles of the values that aren't null.

    Equal values are counted first, so that a value which many rows share (a return of 0) is one row; a range sort by key and
    value then gives each the ranks that it fills, and the two ranks around each point are picked out.  No reducer holds all
    values, however many differ; the driver sees one sum a partition.
    """
    keys = list(keys)
    counts = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = with_total(counts, [*keys, "__v"], "__c", "__to")
    sizes = ranked.groupBy(*keys).agg(F.min(F.col("__to") - F.col("__c")).alias("__first"), F.sum("__c").alias("n")).where("n > 0")
    at = [F.lit(p) * (F.col("n") - 1) for p in points]
    rank = lambda x, side: F.col("__first") + F.least(F.floor(x) + side, F.col("n") - 1)
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), x.alias("__at"), F.lit(side).alias("__side"), rank(x, side).alias("__rank")) for p, x in zip(points, at) for side in (0, 1)])
    met = ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes))  # without keys one row
    met = met.select(*keys, "n", "__v", F.inline(F.filter(wanted, lambda w: (w["__rank"] >= F.col("__to") - F.col("__c")) & (w["__rank"] < F.col("__to")))))
    side = lambda i: F.max(F.when(F.col("__side") == i, F.col("__v")))
    out = met.groupBy(*keys, "p", "n", "__at").agg(side(0).alias("__lo"), side(1).alias("__hi"))
    return out.select(*keys, "p", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at"))).alias("value"), "n")


def thresholds(returns: DataFrame, tails: list[float], keys: list[str] | None = None) -> DataFrame:
    """(tail, alpha_down, alpha_up, n, asymmetry) of pooled returns, or by ``keys``: exact interpolated percentiles.

    Without a return the pooled thresholds are one row a tail of nulls with n 0.
    """
    keys = keys or []
    points = sorted({p for t in tails for p in (t, 1 - t)})
    values = quantiles(returns, "ret", points, keys)
    mean = returns.where("ret is not null").groupBy(*keys).agg(F.avg(F.when(F.col("ret") != 0, F.abs("ret"))).alias("mean_abs"), F.count(F.lit(1)).alias("n"))
    value = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    named = values.groupBy(*keys).agg(F.array(*[F.struct(F.lit(t).alias("tail"), F.abs(value(t)).alias("alpha_down"), value(1 - t).alias("alpha_up")) for t in tails]).alias("q"))
    out = (mean.join(named, keys) if keys else mean.join(named)).withColumn("t", F.explode("q"))
    return out.select(*keys, "t.tail", "t.alpha_down", "t.alpha_up", "n", asymmetry(F.col("t.alpha_down"), F.col("t.alpha_up"), F.col("mean_abs")).alias("asymmetry"))


def percentile_at_scale(values: DataFrame, column: str, p: float) -> DataFrame:
    """(value): one exact percentile of a column, null where it has no value."""
    return quantiles(values, column, [p]).agg(F.max("value").alias("value"))


def label_fixed(rows: DataFrame, alphas: DataFrame) -> DataFrame:
    """``label`` from the one-row table of thresholds: bounds belong to FLAT, rows without a return are -1."""
    a = F.broadcast(alphas.select(F.col("alpha_down").alias("__down"), F.col("alpha_up").alias("__up")))
    label = F.when(F.col("ret").isNull(), INVALID).when(F.col("ret") < -F.col("__down"), DOWN).when(F.col("ret") > F.col("__up"), UP).otherwise(FLAT)
    return rows.join(a).withColumn("label", label).drop("__down", "__up")


def label_atr(rows: DataFrame, window_us: int = 60_000_000, sample_us: int = 10_000, least_rows: int = 10, least_diffs: int = 5, keys: list[str] = GROUP, slice_us: int | None = None) -> DataFrame:
    """Labels against the mean absolute change of the mid over the window before each row.

    The mids of [t - window, t) are thinned to every k-th, k = max(1, int(sample x rows / window)); fewer
    than ``least_rows`` rows or ``least_diffs`` changes give -1, as does a missing return (column ``ret``).
    ``step`` is k; ``label`` compares the return with the change in price units, ``label_rel`` with the change relative to the mid.
    One streamed pass with running sums for each k, whatever the window holds, over slices of ``slice_us``, each with the rows that its
    first ones look back to.  Rows without a mid aren't part of a window; those without a time have an empty one.
    """
    behind = lambda: folds.Behind("ts_us", "__m", window_us, sample_us)
    added = [("__n", T.LongType()), ("__k", T.LongType()), ("__total", T.LongType())]
    dealt = folds.halo(rows.withColumn("__m", mid2().cast("long")), F.col("ts_us"), slice_width(window_us, slice_us), window_us, 0)
    rows = folds.folded(dealt, keys, ["ts_us", "seq"], behind, added, ["__m"])
    diffs = F.ceil(F.col("__n") / F.col("__k")) - 1
    mean = F.col("__total") / F.when(diffs >= 1, diffs)
    valid = F.col("ret").isNotNull() & (F.col("__n") >= least_rows) & (diffs >= least_diffs)
    label = lambda bound: F.when(~valid, INVALID).when(F.col("ret") < -bound, DOWN).when(F.col("ret") > bound, UP).otherwise(FLAT)
    return rows.withColumns({"label": label(mean / 20_000.0), "label_rel": label(mean / mid2()), "step": F.col("__k")}).drop("__n", "__total", "__k")


def label_distribution(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Shares of the labels by group and overall (null keys), among valid rows."""
    share = lambda c: F.round(F.try_divide(F.count_if(F.col("label") == c), F.count(F.lit(1))), 9)
    out = rows.where(F.col("label") != INVALID).groupingSets([[F.col(k) for k in keys], []], *keys)
    return out.agg(F.count(F.lit(1)).alias("n"), share(DOWN).alias("down"), share(FLAT).alias("flat"), share(UP).alias("up"))


def half_spread(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """(keys, half_spread): half the exact median of the relative spread, by ranks, so that no reducer holds a day; null where a group has none."""
    spreads = rows.select(*keys, relative_spread().alias("spread"))
    found = quantiles(spreads, "spread", [0.5], keys)
    return spreads.select(*keys).distinct().join(found, keys, "left").select(*keys, (F.col("value") / 2).alias("half_spread"))


def tail_sweep(rows: DataFrame, tails: list[int], keys: list[str] = GROUP) -> DataFrame:
    """Per group and tail (per cent): thresholds, label shares, and whether both thresholds exceed the half spread.  ``rows`` have ``ret``."""
    alphas = thresholds(rows, [t / 100 for t in tails], keys)
    labelled = rows.where("ret is not null").select(*keys, "ret").join(alphas, keys)
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 9)
    down, up = F.col("ret") < -F.col("alpha_down"), F.col("ret") > F.col("alpha_up")
    out = labelled.groupBy(*keys, "tail", "alpha_down", "alpha_up", "asymmetry").agg(F.count(F.lit(1)).alias("n"), share(down).alias("down"), share(~down & ~up).alias("flat"), share(up).alias("up"))
    out = out.join(half_spread(rows, keys), keys)
    return out.withColumn("ok", (F.col("alpha_down") > F.col("half_spread")) & (F.col("alpha_up") > F.col("half_spread")))


def tail_sweep_pooled(rows: DataFrame, tails: list[int], keys: list[str] = GROUP) -> DataFrame:
    """Thresholds pooled over all groups, and the label shares that they give in each group."""
    alphas = F.broadcast(thresholds(rows, [t / 100 for t in tails]).drop("n", "asymmetry"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 9)
    down, up = F.col("ret") < -F.col("alpha_down"), F.col("ret") > F.col("alpha_up")
    labelled = rows.where("ret is not null").select(*keys, "ret").join(alphas)
    return labelled.groupBy(*keys, "tail", "alpha_down", "alpha_up").agg(F.count(F.lit(1)).alias("n"), share(down).alias("down"), share(~down & ~up).alias("flat"), share(up).alias("up"))
