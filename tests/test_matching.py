import math
import os
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, datasets, features, labels, models, normalise, ranks, reports, validate
from tidemark.sources import exports, sinks

LEFT = "ticker_id int, day_id int, seq long, ts_us long"
RIGHT = "ticker_id int, day_id int, tseq long, ts_us long"


def test_asof_clamps_and_takes_the_last_of_ties(spark):
    left = spark.createDataFrame([(0, 0, i, t) for i, t in enumerate([1, 10, 10, 15, 99])] + [(1, 0, 0, 5)], LEFT)
    right = spark.createDataFrame([(0, 0, 1, 10), (0, 0, 2, 10), (0, 0, 3, 16)], RIGHT)
    got = {(r.ticker_id, r.seq): r.tseq for r in asof.asof(left, right, ["tseq"]).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): 2, (0, 3): 2, (0, 4): 3, (1, 0): None}
    assert {r.seq: r.tseq for r in asof.asof(left.where("ticker_id = 0"), right, ["tseq"], clamp=False).collect()}[0] is None


def test_asof_in_order_never_moves_back(spark):
    left = spark.createDataFrame([(0, 0, 1, 20), (0, 0, 2, 5)], LEFT)
    right = spark.createDataFrame([(0, 0, 1, 4), (0, 0, 2, 20)], RIGHT)
    take = lambda **o: {r.seq: r.tseq for r in asof.asof(left, right, ["tseq"], **o).collect()}
    assert take() == {1: 2, 2: 1} and take(in_order=True) == {1: 2, 2: 2}


def test_accuracy_of_nothing_is_zero_and_shares_are_null(spark):
    rows = spark.createDataFrame([(0, 0, 1, 5, 6, 5, 6)], "ticker_id int, day_id int, seq long, bid_px long, ask_px long, t_bid long, t_ask long")
    assert validate.group_accuracy(rows).first().accuracy == 100.0
    assert validate.mismatch_breakdown(rows).first().bid_only_share is None
    assert spark.range(1).select(validate.accuracy(F.lit(0), F.lit(0)).alias("a")).first().a == 0.0


def test_session_bounds(spark):
    base = 18_000 + 86_400 * 5
    rows = spark.createDataFrame([(0, 0, i, (base + s) * 1_000_000) for i, s in enumerate([34_199, 34_200, 57_599, 57_600])], LEFT)
    assert [r.seq for r in labels.session_filter(rows).orderBy("seq").collect()] == [1, 2]
    summer = spark.createDataFrame([(0, 0, 0, 1_752_586_200_000_000)], LEFT)  # 2025-07-15 13:30 UTC, 09:30 in New York
    assert labels.session_filter(summer, "America/New_York").count() == 1 and labels.session_filter(summer).count() == 0


def snaps(spark, mids, step=100_000):
    return spark.createDataFrame([(0, 0, i, i * step, m, m) for i, m in enumerate(mids)], LEFT + ", b0 long, a0 long")


def test_forward_return_is_half_open(spark):
    got = [r.ret for r in labels.forward_return(snaps(spark, [100, 110, 120, 130]), 100_000).orderBy("seq").collect()]
    assert [None if x is None else round(x, 9) for x in got] == [0.1, round(10 / 110, 9), round(10 / 120, 9), None]


def test_thresholds_of_zero_returns(spark):
    rows = labels.forward_return(snaps(spark, [100] * 6), 100_000)
    r = labels.thresholds(rows, [0.22]).first()
    assert r.alpha_down == 0 and r.asymmetry is None


def test_bounds_belong_to_flat(spark):
    rows = spark.createDataFrame([(-0.2,), (-0.1,), (0.1,), (0.2,), (None,)], "ret double")
    alphas = spark.createDataFrame([(0.1, 0.1)], "alpha_down double, alpha_up double")
    assert [r.label for r in labels.label_fixed(rows, alphas).collect()] == [0, 1, 1, 2, -1]


def test_quantiles_of_a_value_that_most_rows_share(spark):
    rows = spark.range(3000).selectExpr("id % 3 as k", "case when id % 5 < 3 then 0D when id % 7 = 0 then null else (id % 400 - 200) / 8D end as v")
    points = [0.0, 0.1, 0.22, 0.5, 0.78, 1.0]
    want = {(r.k, p): (w, r.n) for r in rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("w"), F.count("v").alias("n")).collect() for p, w in zip(points, r.w)}
    got = {(r.k, r.p): (r.value, r.n) for r in labels.quantiles(rows, "v", points, ["k"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0], abs_tol=1e-12) and got[k][1] == want[k][1] for k in want)
    assert labels.quantiles(rows.where("v > 1000"), "v", points, ["k"]).count() == 0


def test_percentile_at_scale_is_exact(spark):
    values = spark.range(101).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    for p in (0.0, 0.22, 0.785, 1.0):
        want = values.agg(F.percentile("v", F.lit(p)).alias("w")).first().w
        assert math.isclose(labels.percentile_at_scale(values, "v", p).first().value, want)


def test_atr_labels_with_thinning_match_without(spark):
    rows = labels.forward_return(snaps(spark, [1000 + (i * 7) % 13 for i in range(60)], 1000), 2000)
    dense = labels.label_atr(rows, window_us=20_000, sample_us=10).select("seq", "label_rel")
    by_array = labels.label_atr(rows, window_us=20_000, sample_us=2001).select("seq", F.col("label_rel").alias("thin"))
    both = dense.join(by_array, "seq").collect()
    assert len(both) == 60 and any(r.thin != -1 for r in both)

    def brute(i, k):
        mids = [2 * (1000 + (j * 7) % 13) for j in range(60) if i - 20 <= j < i]
        if len(mids) < 10:
            return None
        thin = mids[::k]
        diffs = [abs(a - b) for a, b in zip(thin[1:], thin)]
        return sum(diffs) / len(diffs) if len(diffs) >= 5 else None

    rets = {r.seq: r.ret for r in rows.collect()}
    for r in both:
        for value, k in ((r.label_rel, 1), (r.thin, max(1, int(2001 * min(20, r.seq) / 20_000)))):
            mean = brute(r.seq, k)
            m = 2 * (1000 + (r.seq * 7) % 13)
            want = -1 if mean is None or rets[r.seq] is None else 0 if rets[r.seq] < -mean / m else 2 if rets[r.seq] > mean / m else 1
            assert value == want


def test_zscore_causal_and_centred(spark):
    px = [100, 103, 101, 107, 100, 99]
    arrays = [(0, 0, i, i, [p] * 10, [1] * 10, [p] * 10, [1] * 10) for i, p in enumerate(px)]
    df = spark.createDataFrame(arrays, LEFT + ", bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>")
    for causal in (False, True):
        got = [r.z[0] for r in features.zscore(df, 4, causal).orderBy("seq").collect()]
        for i, z in enumerate(got):
            at = range(i - 3, i + 1) if causal else range(i - 2, i + 2)
            x = [px[min(max(j, 0), 5)] / 1e4 for j in at]
            mean = sum(x) / 4
            var = max(sum(v * v for v in x) / 4 - mean * mean, 1e-8)
            assert abs(z - (px[i] / 1e4 - mean) / var**0.5) < 1e-4


def test_windows_of_short_groups(spark):
    rows = spark.range(9).select(F.lit(0).alias("ticker_id"), F.lit(0).alias("day_id"), F.col("id").alias("seq"))
    assert features.sliding_windows(rows, ["seq"], 10, 4).count() == 0
    got = features.sliding_windows(rows, ["seq"], 4, 3).orderBy("window").collect()
    assert [r.x for r in got] == [[0, 1, 2, 3], [3, 4, 5, 6]]


def test_index_and_splits(spark):
    rows = spark.range(97).repartition(7).select((F.col("id") * 3).alias("v"))
    got = datasets.with_index(rows, ["v"]).collect()
    assert sorted((r["index"], r.v) for r in got) == [(i, 3 * i) for i in range(97)]
    assert datasets.with_index(rows.where("v < 0"), ["v"]).count() == 0


def test_index_of_more_rows_than_the_range_sample(spark):
    n = 400_000
    rows = spark.range(n).repartition(4).select((F.col("id") * 3).alias("v"), (F.col("id") % 2).alias("label"))
    got = datasets.with_index(rows, ["v"]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("distinct"), F.max("index").alias("most"), F.count_if(F.col("v") != 3 * F.col("index")).alias("wrong")).first()
    assert got.asDict() == {"n": n, "distinct": n, "most": n - 1, "wrong": 0}
    split = {r.part: (r.n, r.lo, r.hi) for r in datasets.chronological_split(rows, 0.2, ["v"]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert split == {"train": (320_000, 0, 959_997), "valid": (80_000, 960_000, 1_199_997)}
    value = labels.percentile_at_scale(rows.select(F.col("v").cast("double").alias("v")), "v", 0.78).first().value
    assert math.isclose(value, 3 * 0.78 * (n - 1))
    assert datasets.balanced_sample(rows, 5000, ["v"]).count() == 5000


def test_balanced_sample(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 50, 0).otherwise(1).alias("label"))
    got = datasets.balanced_sample(rows, 2000, ["id"])
    counts = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert sum(counts.values()) == 2000 and abs(counts[0] - 1000) < 150
    cheap = {r.label: r["count"] for r in datasets.poisson_sample(rows).groupBy("label").count().collect()}
    assert abs(cheap[0] - 500) < 120 and abs(cheap[1] - 500) < 120


def test_poisson_sample_of_rare_classes(spark):
    for n, rare in ((100_000, 100), (40_000, 10)):  # mean 500 and mean 2,000, where exp(-mean) is 0
        rows = spark.range(n).select("id", F.when(F.col("id") < rare, 0).otherwise(1).alias("label"))
        got = {r.label: (r["n"], r.ids) for r in datasets.poisson_sample(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).collect()}
        assert abs(got[0][0] - n / 2) < 0.03 * n and abs(got[1][0] - n / 2) < 0.03 * n and got[0][1] == rare


def test_thresholds_are_stored_and_stale_ones_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    assert datasets.load_thresholds(spark, path, ["alpha_down"]) is None
    datasets.save_thresholds(spark.createDataFrame([(0.1,)], "alpha_down double"), path)
    assert datasets.load_thresholds(spark, path, ["alpha_down"]).first().alpha_down == 0.1
    assert datasets.load_thresholds(spark, path, ["alpha_down", "alpha_up"]) is None


def test_stale_thresholds_are_fitted_again(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def fit(columns):
        calls.append(columns)
        return spark.createDataFrame([tuple(0.5 for _ in columns)], ", ".join(f"{c} double" for c in columns))

    assert datasets.fitted_thresholds(spark, path, lambda: fit(["alpha_down"])).first().alpha_down == 0.5
    first = os.listdir(path)
    assert datasets.fitted_thresholds(spark, path, lambda: fit(["alpha_down"])).columns == ["alpha_down"] and os.listdir(path) == first
    assert datasets.fitted_thresholds(spark, path, lambda: fit(["alpha_down", "alpha_up"])).first().alpha_up == 0.5


def test_index_of_three_million_rows(spark):
    rows = spark.range(0, 3_000_000, 1, 8).select((F.col("id") * 7919 % 3_000_000).alias("v"))
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            got = datasets.with_index(rows, ["v"])
            for _ in range(2):
                one = got.agg(F.count_distinct("index").alias("n"), F.max("index").alias("most"), F.count_if(F.col("v") != F.col("index")).alias("wrong")).first()
                assert one.asDict() == {"n": 3_000_000, "most": 2_999_999, "wrong": 0}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_grows_with_its_rows(spark):
    import time

    def took(n):
        left = spark.range(n).select(F.lit(0).alias("ticker_id"), F.lit(0).alias("day_id"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("ts_us"))
        right = left.where("seq % 7 = 3").withColumnRenamed("seq", "tseq")
        began = time.time()
        bad = asof.asof(left, right, ["tseq"]).where("tseq <> greatest(3, seq - pmod(seq - 3, 7))").count()
        assert bad == 0
        return time.time() - began

    took(1000)
    assert took(160_000) < 16 * took(10_000) + 5


def test_asof_with_and_without_buckets(spark):
    draw = random.Random(4)
    left = spark.createDataFrame([(g, 0, i, draw.randrange(1000)) for g in range(3) for i in range(200)], LEFT)
    right = spark.createDataFrame([(g, 0, i, draw.randrange(300, 700)) for g in range(2) for i in range(20)], RIGHT)
    for clamp in (True, False):
        want = {(r.ticker_id, r.seq): r.tseq for r in asof.asof(left, right, ["tseq"], clamp=clamp, bucket_us=10_000).collect()}
        quotes = {g: sorted((r.ts_us, r.tseq) for r in right.collect() if r.ticker_id == g) for g in range(2)}
        for r in left.collect():
            past = [q for q in quotes.get(r.ticker_id, []) if q[0] <= r.ts_us]
            first = min(quotes[r.ticker_id]) if clamp and r.ticker_id in quotes else (None, None)
            assert want[(r.ticker_id, r.seq)] == (past[-1][1] if past else first[1])
        assert {(r.ticker_id, r.seq): r.tseq for r in asof.asof(left, right, ["tseq"], clamp=clamp, bucket_us=50).collect()} == want


def test_folds_do_not_depend_on_batches(spark):
    draw = random.Random(6)
    rows = [(g, 0, i, i * 700 + draw.randrange(600), 1000 + draw.randrange(50), 1010 + draw.randrange(50)) for g in range(3) for i in range(90)]
    df = spark.createDataFrame(rows, LEFT + ", b0 long, a0 long")

    def results():
        out = labels.label_atr(labels.forward_return(df, 3000), 9000, 2000)
        return sorted(map(str, out.collect()))

    want = results()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert results() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_asof_over_long_gaps(spark):
    """A stray quote at time 0 carries over decades without a row a bucket."""
    t = 1_700_000_000_000_000
    right = spark.createDataFrame([(0, 0, 1, 0), (0, 0, 2, t), (0, 0, 3, t + 10**12), (1, 0, 4, 5)], RIGHT)
    times = [-5, 0, 10**9, t // 2, t - 1, t, t + 1, t + 10**11, t + 10**12 - 1, t + 10**12, t + 10**13]
    left = spark.createDataFrame([(g, 0, i, x) for g in range(3) for i, x in enumerate(times)], LEFT)
    out = asof.asof(left, right, ["tseq"])
    got = {(r.ticker_id, r.seq): r.tseq for r in out.collect()}
    assert [got[(0, i)] for i in range(len(times))] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3]
    assert all(got[(1, i)] == 4 and got[(2, i)] is None for i in range(len(times)))


def tasks_with_rows(df):
    return len(df.groupBy(F.spark_partition_id()).agg(*[F.max(c) for c in df.columns]).collect())  # all columns, so that none is pruned


def test_scan_spreads_a_day_over_tasks(spark):
    draw = random.Random(8)
    rows = [(g, i, draw.choice([None, draw.randrange(50)])) for g in (0, None) for i in range(1, 2001) if draw.random() < 0.8]
    df = spark.createDataFrame(rows, "k int, seq long, v int")
    values = {"top": ("max", F.col("v")), "total": ("sum", F.col("v")), "kept": ("last", F.col("v")), "n": ("sum", F.lit(1).cast("long"))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for slice_rows in (1, 50, 10_000):
            out = ranks.scan(df, ["k"], "seq", values, slice_rows)
            if slice_rows == 50:
                assert tasks_with_rows(out.where("k = 0")) >= 8  # of 16 tasks, for the 40 slices of one day
            got = {(r.k, r.seq): (r.top, r.total, r.kept, r.n) for r in out.collect()}
            assert len(got) == len(rows)
            for key in (0, None):
                top = total = kept = None
                for n, (_, seq, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
                    if v is not None:
                        top, total, kept = max(v, top or 0), v + (total or 0), v
                    assert got[(key, seq)] == (top, total, kept, n)
        assert ranks.scan(df.where("false"), ["k"], "seq", values).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gates_spread_a_day_over_tasks(spark):
    rows = spark.range(1, 400_001).select(F.lit(0).alias("ticker_id"), F.lit(0).alias("day_id"), F.col("id").alias("seq"), F.col("id").alias("ts_us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert validate.prefix_cut(rows, F.col("seq") == 399_000).count() == 398_999 and validate.latch(rows, F.col("seq") == 399_000).count() == 1001
        assert tasks_with_rows(asof.monotone(rows, ["ticker_id", "day_id"], "ts_us", "seq")) >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_folds_do_not_depend_on_slices(spark):
    draw = random.Random(16)
    rows = [(g, 0, i, None if draw.random() < 0.05 else i * 700 + draw.randrange(600), None if draw.random() < 0.1 else 1000 + draw.randrange(50), 1010 + draw.randrange(50)) for g in range(2) for i in range(200)]
    df = spark.createDataFrame(rows, LEFT + ", b0 long, a0 long")
    returns = {w: {(r.ticker_id, r.seq): r.ret for r in labels.forward_return(df, 3000, slice_us=w).collect()} for w in (500, 7000, 10**12)}
    assert returns[500] == returns[7000] == returns[10**12] and len(returns[500]) == len(rows)
    for g, _, i, t, b, a in rows:
        near = [r[4] + r[5] for r in rows if r[0] == g and t is not None and r[3] is not None and r[4] is not None and t + 3000 <= r[3] < t + 6000]
        want = None if t is None or b is None or not near else (sum(near) - len(near) * (b + a)) / (len(near) * (b + a))
        assert returns[500][(g, i)] == want
    marked = df.withColumn("ret", F.when(F.col("b0").isNotNull(), F.lit(0.001)))
    atr = {w: sorted(str(r) for r in labels.label_atr(marked, 9000, 2000, slice_us=w).select("ticker_id", "seq", "label", "label_rel", "step").collect()) for w in (500, 7000, 10**12)}
    assert atr[500] == atr[7000] == atr[10**12] and len(atr[500]) == len(rows)
    by = {(r.ticker_id, r.seq): r for r in labels.label_atr(marked, 9000, 2000, slice_us=500).collect()}
    for g, _, i, t, b, a in rows:
        mids = [x for _, x in sorted((r[3], r[4] + r[5]) for r in rows if r[0] == g and t is not None and r[3] is not None and r[4] is not None and t - 9000 <= r[3] < t)]
        step = max(1, int(len(mids) * 2000 / 9000))
        thin = mids[::step]
        mean = sum(abs(x - y) for x, y in zip(thin[1:], thin)) / max(len(thin) - 1, 1)
        want = -1 if b is None or len(mids) < 10 or len(thin) - 1 < 5 else 2 if 0.001 > mean / 20_000 else 1
        assert (by[(g, i)].step, by[(g, i)].label) == (step, want)


@pytest.mark.parametrize("causal", [False, True])
def test_zscores_do_not_depend_on_slices_and_pass_nulls(spark, causal):
    draw = random.Random(17)
    level = lambda lo: [None if draw.random() < 0.1 else lo + draw.randrange(40) for _ in range(10)]
    rows = [(g, 0, 3 * i, i, level(1000), level(10), level(1100)[: draw.choice([10, 7])], None if draw.random() < 0.1 else level(10)) for g in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, LEFT + ", bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>")
    got = {s: {(r.ticker_id, r.seq): r.z for r in features.zscore(df, 8, causal, slice_rows=s).collect()} for s in (3, 50, 10_000)}
    assert len(got[3]) == len(rows)
    for key, z in got[3].items():
        for other in (got[50][key], got[10_000][key]):
            assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(z, other))
    for g in range(2):
        held = [r for r in rows if r[0] == g]
        value = lambda r, f: (lambda c: None if c is None or f // 4 >= len(c) else c[f // 4])(r[(6, 4, 7, 5)[f % 4]])
        for i, r in enumerate(held):
            for f in range(40):
                at = range(i - 7, i + 1) if causal else range(i - 4, i + 4)
                x = [value(held[min(max(j, 0), 59)], f) for j in at]
                x = [v / (1e4 if f % 4 < 2 else 1) for v in x if v is not None]
                own, z = value(r, f), got[50][(g, r[2])][f]
                if own is None:
                    assert z is None
                else:
                    mean = sum(x) / len(x)
                    assert abs(z - (own / (1e4 if f % 4 < 2 else 1) - mean) / max(sum((v - mean) ** 2 for v in x) / len(x), 1e-8) ** 0.5) < 1e-6


def test_half_spread_is_the_median(spark):
    draw = random.Random(3)
    rows = [(g, 0, i, i, None if g == 2 or draw.random() < 0.1 else 100 + draw.randrange(9), 110 + draw.randrange(9)) for g in range(3) for i in range(101 + g)]
    df = spark.createDataFrame(rows, LEFT + ", b0 long, a0 long")
    want = {r.ticker_id: r.m for r in df.groupBy("ticker_id").agg((F.median(labels.relative_spread()) / 2).alias("m")).collect()}
    got = {r.ticker_id: r.half_spread for r in labels.half_spread(df).collect()}
    assert got.keys() == want.keys() and all((want[g] is None and got[g] is None) or math.isclose(got[g], want[g]) for g in want)


def test_reports_are_sorted(spark):
    rows = spark.createDataFrame([(t, d, 1, 1000 * d) for t in (3, 1, 2) for d in (5, 4, 6) for _ in range(2)], LEFT)
    for report in (reports.counts_rollup({"orders": rows}), reports.duration_rate(rows), reports.rate_buckets(rows), reports.dataset_size(rows)):
        keys = [(r.ticker_id is not None, r.ticker_id or 0, r.day_id is not None, r.day_id or 0) for r in report.collect()]
        assert keys == sorted(keys) and len(keys) >= 9


def test_what_is_staged_goes_with_the_driver(tmp_path):
    """A driver of its own: its folders are there while it runs, and gone afterwards."""
    import subprocess
    import sys

    code = f"""
import os
from pyspark.sql import SparkSession
from tidemark.operators.materialise import scratch_folder, staged
spark = SparkSession.builder.master("local").config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
folder = scratch_folder(spark, "scratch")
assert staged(spark.range(5), "kept").count() == 5
spark.range(3).write.parquet(folder + "/in")
print("THERE", sum(len(files) > 0 for _, _, files in os.walk("{tmp_path}/shared")))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "THERE 2" in out.stdout, out.stderr[-500:]
    left = [f for _, _, files in os.walk(tmp_path / "shared") for f in files]
    assert left == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 1, [3], [4]), (1, 6, 2, [5], [6])], "ticker_id int, day_id int, seq long, bid_px array<long>, ask_px array<long>")
    sinks.write_partitioned(sinks.with_top_columns(rows), str(tmp_path / "a"))
    got = spark.read.parquet(str(tmp_path / "a"))
    assert sorted((r.day_id, r.b0, r.a0) for r in got.collect()) == [(5, 3, 4), (6, 5, 6)] and (tmp_path / "a" / "ticker_id=1" / "day_id=5").is_dir()
    calendar = spark.createDataFrame([(5, "train"), (6, "test")], "day_id int, split string")
    datasets.concatenated(rows, calendar, str(tmp_path / "b"))
    assert {r.split: r.seq for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {"train": 1, "test": 2}
    for _ in range(2):
        models.append_metrics(spark.createDataFrame([(0.5,)], "accuracy double"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    doubled = models.map_groups(rows.select("day_id", "seq"), ["day_id"], lambda t: t.append_column("twice", pc.multiply(t["seq"], 2)), "day_id int, seq long, twice long")
    assert sorted(r.twice for r in doubled.collect()) == [2, 4]


def test_windows_train_and_score(spark):
    draw = random.Random(3)
    rows = []
    for g in range(2):
        for i in range(120):
            px = 1_000_000 + (i % 30) * 200 * (1 if (i // 30) % 2 else -1)
            rows.append((g, 0, i, i * 1000, [px - k for k in range(10)], [10] * 10, [px + 1 + k for k in range(10)], [10 + draw.randrange(5)] * 10, px, px + 1))
    df = spark.createDataFrame(rows, LEFT + ", bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>, b0 long, a0 long").withColumn("ts_us", F.col("ts_us") + 18_000_000_000 + 40_000_000_000)
    alphas = spark.createDataFrame([(1e-5, 1e-5)], "alpha_down double, alpha_up double")
    made = datasets.windows_dataset(df, alphas, 2000, 10, 10, 4, 20)
    valid = {(r.ticker_id, r.seq): r.label for r in labels.label_fixed(labels.forward_return(df, 2000), alphas).where("label <> -1").collect()}
    z = {(r.ticker_id, r.seq): r.z for r in features.zscore(df, 10).collect()}
    want = {}
    for g in range(2):
        seqs = sorted(s for t, s in valid if t == g)
        for w in range((len(seqs) - 10) // 4 + 1):
            part = seqs[4 * w : 4 * w + 10]
            want[(g, w)] = ([z[(g, s)] for s in part], valid[(g, part[-1])])
    assert {(r.ticker_id, r.window): (r.x, r.y) for r in made.collect()} == want and len(want) > 40
    summed = models.summarised(made, ["ticker_id", "day_id"])
    model = models.train(summed)
    got = models.scored(model, summed, ["ticker_id", "day_id"]).collect()
    assert len(got) == len(want) and sum(r.label == r.pred for r in got) / len(got) > 0.5
    b, c = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    vectors = {(r.ticker_id, r.window): r.features.toArray() for r in summed.collect()}
    for r in got:
        logits = b @ vectors[(r.ticker_id, r.window)] + c
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert r.pred == int(p.argmax()) and math.isclose(r.loss, -math.log(max(p[r.label], 1e-12)), rel_tol=1e-6, abs_tol=1e-9)
    # At the fitted coefficients the gradient of the weighted, penalised loss is nearly zero: more steps would lead nowhere.
    y, x = np.array([r.y for r in summed.collect()]), np.array([r.features.toArray() for r in summed.collect()])
    share = {c: 1 / ((y == c).mean() + 1e-8) for c in set(y.tolist())}
    w = np.array([share[c] for c in y.tolist()])
    near, far = models.train(summed, 2000), models.train(summed, 1)

    def slope(model):
        b, c = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        z = x @ b.T + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        scale = x.std(axis=0, ddof=1)  # the penalty is on standardised features
        off = (p - np.eye(p.shape[1])[y]) * w[:, None] / w.sum()
        grad = np.where(scale > 0, off.T @ x / np.maximum(scale, 1e-12) + 1e-3 * b * scale, 0)
        return max(np.abs(grad).max(), np.abs(off.sum(axis=0)).max())

    assert slope(near) < 2e-3 and slope(near) < slope(far) / 20
    flat = made.select("ticker_id", "window", F.flatten("x").alias("all"))
    chance = {(r.ticker_id, r.window): r.score for r in models.batch_scored(flat, models.window_scorer(model, 10, 2), "all", 400).collect()}
    same = model.transform(summed).select("ticker_id", "window", "probability").collect()
    assert len(chance) == len(same) and all(math.isclose(chance[(r.ticker_id, r.window)], r.probability[2], rel_tol=1e-4, abs_tol=1e-6) for r in same)
    batch = models.batch_scored(made.select("window", F.element_at("x", -1).alias("last")), lambda: lambda x: np.asarray(x, float).sum(axis=1), "last", 40).collect()
    assert all(math.isclose(r.score, sum(r["last"]), rel_tol=1e-6, abs_tol=1e-6) for r in batch)


def test_exports(spark, tmp_path):
    (tmp_path / "mbo.csv").write_text("ts_event,rtype,instrument_id,action,side,price,size,order_id,sequence\n1000,160,7,A,B,100000000,5,9,3\n2000,160,7,C,A,9223372036854775807,5,9,4\n")
    (tmp_path / "mbp.csv").write_text("ts_event,instrument_id,bid_px_00,ask_px_00,bid_sz_00,ask_sz_00,bid_px_01,sequence\n1000,7,100000000,200000000,5,6,1,3\n")
    inst = spark.createDataFrame([(0, "x", 7)], "ticker_id int, ticker string, instrument_id int")
    got = [tuple(r) for r in normalise.orders(exports.read_mbo(spark, str(tmp_path / "mbo.csv")), inst).orderBy("seq").collect()]
    assert got == [(0, "x", 3, 1, 1, 9, 5, 1000, 1), (0, "x", 4, 2, 2, 9, 5, 0, -1)]
    assert [tuple(r) for r in normalise.quotes(exports.read_mbp(spark, str(tmp_path / "mbp.csv")), inst).collect()] == [(0, "x", 3, 1, 1000, 5, 2000, 6)]


def test_negative_sizes_are_refused(spark):
    raw = spark.createDataFrame([(1000, 1, 1, "A", "B", 10**9, -1, 5)], "ts_event long, seq long, instrument_id int, action string, side string, price long, size int, order_id long")
    inst = spark.createDataFrame([(0, "x", 1)], "ticker_id int, ticker string, instrument_id int")
    try:
        normalise.orders(raw, inst).collect()
    except Exception as e:
        assert "negative size" in str(e)
    else:
        raise AssertionError


def test_level0(spark):
    rows = spark.createDataFrame([(1, [(5, 1, 6, 1)]), (2, [])], "id int, levels array<struct<bid_px:long,bid_sz:int,ask_px:long,ask_sz:int>>")
    assert [tuple(r) for r in normalise.level0(rows).collect()] == [(1, 5, 1, 6, 1)]
