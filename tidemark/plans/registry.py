"""The registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, book, datasets, features, labels, models, normalise, reports, validate
from tidemark.operators.materialise import scratch_folder, staged
from tidemark.plans import oracles as o
from tidemark.sources import fixedrec, sinks
from tidemark.sources.fixtures import GROUP, arrivals, feed_folder, fixture, keyed, levels, quote_folder
from tidemark.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
G = o.G
PASS, MARGINAL = 68.0, 64.0  # tiers that the fixture's quotes can tell apart
H = 600_000_000  # horizon of the snapshot fixture
TAILS, POOLED = [15, 18, 20, 22, 25, 28, 30], [20, 22, 25]


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def mbo(spark, d):
    """The messages, written once a query: the operators read them several times."""
    return staged(fixture(spark, d, "mbo"), "mbo")


def truth(spark, d):
    return fixture(spark, d, "truth")


def feeds(spark, d, quotes="truth"):
    m = mbo(spark, d)
    return m, fixture(spark, d, quotes, m)


def compared(spark, d):
    snaps, t, n = stored(spark, d)
    return validate.compared(snaps, t, n_rows=n).where("t_bid is not null"), n


def stored(spark, d):
    """The data set of gated snapshots as a validator finds it, the quotes, and the number of messages."""
    m, t = feeds(spark, d)
    n = m.count()
    return book.snapshots(validate.session_gate(m, t, n_rows=n), n_rows=n), t, n


def offline(spark, d):
    """Stored snapshots against quotes of which some lack a side."""
    m, t = feeds(spark, d)
    n = m.count()
    return validate.offline(book.snapshots(validate.session_gate(m, t, n_rows=n), n_rows=n), fixture(spark, d, "truth_zero", m), n_rows=n)


def day_accuracy(spark, d):
    m, t = feeds(spark, d)
    return validate.day_book(m, t, n_rows=m.count())[1]


def snap(spark, d):
    return labels.session_filter(fixture(spark, d, "snap_all"))


def returned(spark, d):
    return labels.forward_return(snap(spark, d), H)


def pooled_alphas(spark, d):
    return labels.thresholds(returned(spark, d), [0.22])


def labelled(spark, d):
    return labels.label_fixed(returned(spark, d), pooled_alphas(spark, d))


MZ = o.given("mbo", "truth", "truth_zero")
MT, MTG = o.given("mbo", "truth"), [*o.given("mbo", "truth"), *o.GATED]
SNAP = [*o.given("snap"), *o.returns(H)]
LABELLED = [*SNAP, o.alphas([0.22]), "lb AS MATERIALIZED (SELECT fr.*, CAST(CASE WHEN ret IS NULL THEN -1 WHEN ret < -alpha_down THEN 0 WHEN ret > alpha_up THEN 2 ELSE 1 END AS INT) AS label FROM fr, al)"]

# --- the book -----------------------------------------------------------------------------------


@register("order_lifecycle", o.query([*o.given("mbo"), *o.ALL, *o.LIFE], f"SELECT {G}, seq, order_id, epoch, remaining FROM l"))
def order_lifecycle(spark, d):
    m = mbo(spark, d)
    return book.lifecycle(m, n_rows=m.count()).select(*GROUP, "seq", "order_id", "epoch", "remaining")


@register("level_deltas", o.query([*o.given("mbo"), *o.ALL, *o.DELTAS], f"SELECT {G}, seq, side, px, delta FROM d"))
def level_deltas(spark, d):
    m = mbo(spark, d)
    return book.level_deltas(m, n_rows=m.count())


@register("level_volume", o.query([*o.given("mbo"), *o.ALL, *o.LEVELS], f"SELECT {G}, side, px, seq, volume FROM lv"))
def level_volume(spark, d):
    m = mbo(spark, d)
    n = m.count()
    return book.level_volumes(book.level_deltas(m, n_rows=n), n_rows=n)


BBO_SQL = o.query([*o.given("mbo"), *o.ALL, *o.BBO], f"SELECT {G}, seq, bid_px, ask_px FROM bb")


@register("bbo", BBO_SQL)
def bbo(spark, d):
    m = mbo(spark, d)
    return book.bbo(book.snapshots(m, n_rows=m.count())).select(*GROUP, "seq", "bid_px", "ask_px")


@register("bbo_stab", BBO_SQL)
def bbo_stab(spark, d):
    m = mbo(spark, d)
    return book.bbo_stab(m, n_rows=m.count())


TOP = f"""SELECT ticker_id, day_id, seq, side, level, px, volume AS vol FROM (SELECT f.ticker_id, f.day_id, f.seq, side, px, volume,
    row_number() OVER (PARTITION BY f.ticker_id, f.day_id, f.seq, side ORDER BY -px * side) AS level FROM feed f JOIN {o.STAB}) WHERE level <= 10"""


@register("snapshots_top10", o.query([*o.given("mbo"), *o.ALL, *o.LEVELS], TOP))
def snapshots_top10(spark, d):
    m = mbo(spark, d)
    return book.exploded(book.snapshots(m, slice_rows=4096, n_rows=m.count()))


@register("snapshots_emit_all", o.query([*MTG, *o.BBO, o.SNAP_TIME], f"SELECT bb.ticker_id, bb.day_id, bb.seq, ts_us, snap_us, bid_px, ask_px FROM bb JOIN tm ON {o.same('bb', 'tm')} AND bb.seq = tm.seq"))
def snapshots_emit_all(spark, d):
    snaps = stored(spark, d)[0]
    return snaps.select(*GROUP, "seq", "ts_us", "snap_us", F.col("bid_px")[0].alias("bid_px"), F.col("ask_px")[0].alias("ask_px"))


@register("depth_at", o.query([*MT, *o.ALL, *o.DELTAS, "q AS (SELECT ticker_id, day_id, tseq AS upto FROM truth)"], f"""SELECT * FROM (SELECT ticker_id, day_id, upto, side, px, volume, row_number() OVER (PARTITION BY {G}, upto, side ORDER BY -px * side) AS level FROM
    (SELECT q.ticker_id, q.day_id, upto, side, px, CAST(sum(delta) AS BIGINT) AS volume FROM q JOIN d ON {o.same('q', 'd')} AND d.seq <= upto GROUP BY q.ticker_id, q.day_id, upto, side, px) WHERE volume > 0) WHERE level <= 5"""))  # fmt: skip
def depth_at(spark, d):
    """The book at the message of every quote."""
    m, t = feeds(spark, d)
    n = m.count()
    return book.depth_at(book.level_deltas(m, n_rows=n), t.select(*GROUP, F.col("tseq").alias("at")), 5, n_rows=n).withColumnRenamed("at", "upto")


# --- matching and validation ---------------------------------------------------------------------


@register("book_accuracy", o.query([*MT, *o.ACC], f"SELECT {G}, matched, failed, accuracy FROM acc"))
def book_accuracy(spark, d):
    return day_accuracy(spark, d)


@register("asof_truth", o.query([*MT, *o.ALL, f"ft AS (SELECT {G}, min(tseq) AS s0 FROM truth GROUP BY {G})"], f"SELECT m.ticker_id, m.day_id, m.seq, coalesce(t.tseq, s0) AS tseq FROM mbo m ASOF LEFT JOIN truth t ON {o.same('m', 't')} AND m.ts_us >= t.ts_us LEFT JOIN ft ON {o.same('m', 'ft')}"))
def asof_truth(spark, d):
    m, t = feeds(spark, d)
    return asof.asof(m.select(*GROUP, "seq", "ts_us"), t, ["tseq"], n_rows=m.count()).select(*GROUP, "seq", "tseq")


@register("asof_truth_driven", o.query([*MTG, *o.BBO, o.SNAP_TIME, *o.STORED], f"SELECT t.ticker_id, t.day_id, tseq, b.seq, t.bid_px = b.bid_px AND t.ask_px = b.ask_px AS hit FROM truth t ASOF JOIN sb b ON {o.same('t', 'b')} AND t.ts_us >= b.snap_us WHERE abs(t.ts_us - b.snap_us) < 1000"))
def asof_truth_driven(spark, d):
    snaps, t, n = stored(spark, d)
    return validate.truth_driven(snaps, t, n_rows=n).select(*GROUP, "tseq", "seq", "hit")


@register("tolerance_accuracy", o.query([*MZ, *o.NEAR], f"SELECT {G}, count(*) AS checked, count(*) FILTER (WHERE {o.HIT}) AS matched, round(100.0::DOUBLE * count(*) FILTER (WHERE {o.HIT}) / count(*), 9) AS accuracy FROM nr GROUP BY {G}"))
def tolerance_accuracy(spark, d):
    return validate.tolerance_accuracy(offline(spark, d))


@register("accuracy_tiers", o.query([*MT, *o.ACC], f"SELECT {G}, accuracy, CASE WHEN accuracy >= {PASS} THEN 'PASS' WHEN accuracy >= {MARGINAL} THEN 'MARGINAL' ELSE 'FAIL' END AS tier FROM acc"))
def accuracy_tiers(spark, d):
    return day_accuracy(spark, d).select(*GROUP, "accuracy", validate.tier(F.col("accuracy"), PASS, MARGINAL).alias("tier"))


def _suite(policy: str) -> None:
    p = dict(validate.POLICIES[policy], count=6) if policy == "four" else validate.POLICIES[policy]
    tickers = "ticker_id < 4" if policy == "four" else "true"
    good = "('PASS', 'MARGINAL')" if p["marginal_passes"] else "('PASS')"
    skip = "('MISSING')" if p["empty_fails"] else "('MISSING', 'EMPTY')"
    base = "total" if p["missing_counts"] else "(total - skipped)"
    ok = f"passed >= {p['count']}" if p["count"] is not None else f"coalesce(rate >= {p['rate']}, false)"
    if p["missing_forbids"]:
        ok += " AND missing = 0"
    if policy == "all":  # this suite has no session gate
        parts = [*MT, *o.BOUNDS, *o.ALL, *o.COMPARED, f"acc AS (SELECT {G}, round(100.0::DOUBLE * count(*) FILTER (WHERE {o.HIT}) / count(*), 9) AS accuracy FROM cmp GROUP BY {G})"]
    else:
        parts = [*MT, *o.ACC]
    parts += [*o.given("instruments", "calendar"), f"ex AS (SELECT ticker_id, day_id FROM instruments, calendar WHERE {tickers})", f"pr AS (SELECT DISTINCT {G} FROM mbo)",
        f"""st AS (SELECT ex.ticker_id, CASE WHEN pr.day_id IS NULL THEN 'MISSING' WHEN accuracy IS NULL THEN 'EMPTY' WHEN accuracy >= {PASS} THEN 'PASS' WHEN accuracy >= {MARGINAL} THEN 'MARGINAL' ELSE 'FAIL' END AS state
        FROM ex LEFT JOIN pr ON {o.same('ex', 'pr')} LEFT JOIN acc ON {o.same('ex', 'acc')})""",
        f"sm AS (SELECT ticker_id, count(*) AS total, count(*) FILTER (WHERE state IN {good}) AS passed, count(*) FILTER (WHERE state IN {skip}) AS skipped, count(*) FILTER (WHERE state = 'MISSING') AS missing FROM st GROUP BY ROLLUP (ticker_id))",
        f"s2 AS (SELECT *, total - passed - skipped AS failed, round(100.0::DOUBLE * passed / nullif({base}, 0), 9) AS rate FROM sm)"]

    @register(f"suite_summary_{policy}", o.query(parts, f"SELECT ticker_id, total, passed, skipped, missing, failed, rate, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s2"))
    def suite(spark, d):
        expected = fixture(spark, d, "instruments").select("ticker_id").where(tickers).crossJoin(fixture(spark, d, "calendar").select("day_id"))
        m, t = feeds(spark, d)
        if policy == "all":
            n = m.count()
            acc = validate.group_accuracy(validate.compared(book.snapshots(validate.valid_time(m), n_rows=n), t, n_rows=n).where("t_bid is not null"))
        else:
            acc = validate.day_book(m, t, n_rows=m.count())[1]
        return validate.suite_summary(expected, m.select(*GROUP).distinct(), acc, p, PASS, MARGINAL)


for _policy in ("all", "four", "final"):
    _suite(_policy)


def _share(c: str) -> str:
    return f"round(100.0::DOUBLE * {c} / nullif(checked - matched, 0), 9) AS {c}_share"


@register("mismatch_breakdown", o.query([*MZ, *o.NEAR, f"""mm AS (SELECT {G}, count(*) AS checked, count(*) FILTER (WHERE {o.HIT}) AS matched, count(*) FILTER (WHERE bid_px <> t_bid AND ask_px = t_ask) AS bid_only,
    count(*) FILTER (WHERE bid_px = t_bid AND ask_px <> t_ask) AS ask_only, count(*) FILTER (WHERE bid_px <> t_bid AND ask_px <> t_ask) AS both_, count(*) FILTER (WHERE bid_px > t_bid) AS bid_high, count(*) FILTER (WHERE bid_px < t_bid) AS bid_low,
    count(*) FILTER (WHERE ask_px > t_ask) AS ask_high, count(*) FILTER (WHERE ask_px < t_ask) AS ask_low FROM nr GROUP BY {G})"""],
    f"SELECT * EXCLUDE (both_), both_ AS \"both\", {_share('bid_only')}, {_share('ask_only')}, {_share('both_').replace('both__share', 'both_share')} FROM mm"))
def mismatch_breakdown(spark, d):
    return validate.mismatch_breakdown(offline(spark, d))


@register("mismatch_first20", o.query([*MZ, *o.NEAR], f"SELECT * FROM (SELECT {G}, row_number() OVER (PARTITION BY {G} ORDER BY seq) AS place, seq, bid_px, ask_px, t_bid, t_ask, bid_px - t_bid AS bid_delta, ask_px - t_ask AS ask_delta FROM nr WHERE NOT {o.HIT}) WHERE place <= 20"))
def mismatch_first20(spark, d):
    return validate.first_mismatches(offline(spark, d))


@register("running_accuracy", o.query([*MTG, *o.COMPARED], f"""SELECT {G}, seq, processed, matched, round(100.0::DOUBLE * matched / processed, 9) AS accuracy, CASE WHEN 100.0::DOUBLE * matched / processed >= 98 THEN 'PASS' WHEN 100.0::DOUBLE * matched / processed >= 90 THEN 'MARGINAL' ELSE 'FAIL' END AS tier
    FROM (SELECT {G}, seq, count(*) OVER w AS processed, CAST(sum(CAST({o.HIT} AS INT)) OVER w AS BIGINT) AS matched FROM cmp WINDOW w AS (PARTITION BY {G} ORDER BY seq)) WHERE processed % 500 = 0"""))  # fmt: skip
def running_accuracy(spark, d):
    rows, n = compared(spark, d)
    return validate.running_accuracy(rows, 500, n_rows=n)


@register("session_gate", o.query(MTG, f"SELECT {G}, seq, ts_us >= open_us AND ts_us <= close_us AS inside FROM feed"))
def session_gate(spark, d):
    m, t = feeds(spark, d)
    return validate.session_gate(m, t, n_rows=m.count()).select(*GROUP, "seq", F.col("ts_us").between(F.col("open_us"), F.col("close_us")).alias("inside"))


@register("prefix_cut", o.query(o.given("mbo"), f"SELECT {G}, seq FROM (SELECT {G}, seq, max(CAST(price >= 10000000 AS INT)) OVER (PARTITION BY {G} ORDER BY seq) AS x FROM mbo) WHERE x = 0"))
def prefix_cut(spark, d):
    m = mbo(spark, d)
    return validate.prefix_cut(m, F.col("price") >= book.MAX_PRICE, n_rows=m.count()).select(*GROUP, "seq")


@register("latch", o.query(o.given("mbo"), f"SELECT {G}, seq FROM (SELECT {G}, seq, max(CAST(price >= 10000000 AS INT)) OVER (PARTITION BY {G} ORDER BY seq) AS x FROM mbo) WHERE x = 1"))
def latch(spark, d):
    m = mbo(spark, d)
    return validate.latch(m, F.col("price") >= book.MAX_PRICE, n_rows=m.count()).select(*GROUP, "seq")


@register("timestamp_counts", o.query([*MTG, o.SNAP_TIME], f"SELECT {G}, count(*) AS total, count(*) FILTER (WHERE snap_us > 1000000) AS valid FROM tm GROUP BY {G}"))
def timestamp_counts(spark, d):
    return validate.timestamp_counts(stored(spark, d)[0])


# --- feeds and reports ---------------------------------------------------------------------------

_KNOWN = "{c} IS NOT NULL AND {c} <> 9223372036854775807 AND {c} > 0"


@register("normalise_mbo", o.query(o.given("mbo_raw", "instruments"), f"""SELECT * FROM (SELECT ticker_id, ticker, seq, ts_event // 1000 AS ts_us, CASE WHEN action IN ('A', 'M') THEN 1 WHEN action = 'C' THEN 2 WHEN action IN ('D', 'R') THEN 3 WHEN action = 'F' THEN 4 END AS event_type,
    order_id, size, CASE WHEN {_KNOWN.format(c='price')} THEN price // 100000 ELSE 0 END AS price, CASE WHEN side = 'B' THEN 1 ELSE -1 END AS direction FROM mbo_raw JOIN instruments USING (instrument_id)) WHERE event_type IS NOT NULL AND (event_type <> 1 OR price > 0)"""))  # fmt: skip
def normalise_mbo(spark, d):
    return normalise.orders(fixture(spark, d, "mbo_raw"), fixture(spark, d, "instruments"))


@register("normalise_mbp", o.query(o.given("mbo_raw", "mbp_raw", "instruments"), f"""SELECT ticker_id, ticker, seq AS tseq, ts_event // 1000 AS ts_us, bid_px // 100000 AS bid_px, bid_sz, ask_px // 100000 AS ask_px, ask_sz FROM mbp_raw JOIN instruments USING (instrument_id)
    WHERE {_KNOWN.format(c='bid_px')} AND {_KNOWN.format(c='ask_px')} AND bid_px // 100000 > 0 AND bid_px // 100000 < ask_px // 100000"""))  # fmt: skip
def normalise_mbp(spark, d):
    return normalise.quotes(fixture(spark, d, "mbp_raw"), fixture(spark, d, "instruments"))


@register("truth_valid", o.query(o.given("mbo_raw", "mbp_raw", "instruments"), f"""SELECT ticker, count(*) AS n, min(ask_px // 100000 - bid_px // 100000) AS least_spread FROM mbp_raw JOIN instruments USING (instrument_id)
    WHERE {_KNOWN.format(c='bid_px')} AND {_KNOWN.format(c='ask_px')} AND bid_px // 100000 > 0 AND bid_px // 100000 < ask_px // 100000 GROUP BY ticker"""))  # fmt: skip
def truth_valid(spark, d):
    q = normalise.quotes(fixture(spark, d, "mbp_raw"), fixture(spark, d, "instruments"))
    return q.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ask_px") - F.col("bid_px")).alias("least_spread"))


@register("manifest_missing", o.query([*o.given("mbo", "truth", "truth_gap"), *o.given("instruments", "calendar"), f"a AS (SELECT {G}, count(*) AS n FROM mbo GROUP BY {G})", f"b AS (SELECT {G}, count(*) AS n FROM truth_gap GROUP BY {G})"], """SELECT i.ticker_id, c.day_id, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS quotes, concat_ws(',', CASE WHEN a.n IS NULL THEN 'orders' END, CASE WHEN b.n IS NULL THEN 'quotes' END) AS missing
    FROM instruments i CROSS JOIN calendar c LEFT JOIN a ON a.ticker_id = i.ticker_id AND a.day_id = c.day_id LEFT JOIN b ON b.ticker_id = i.ticker_id AND b.day_id = c.day_id WHERE a.n IS NULL OR b.n IS NULL"""))  # fmt: skip
def manifest_missing(spark, d):
    expected = fixture(spark, d, "instruments").select("ticker_id").crossJoin(fixture(spark, d, "calendar").select("day_id"))
    m, t = feeds(spark, d, "truth_gap")
    return reports.manifest_missing(expected, {"orders": m, "quotes": t})


@register("counts_rollup", o.query(MT, f"SELECT {G}, count(*) FILTER (WHERE k = 'orders') AS orders, count(*) FILTER (WHERE k = 'quotes') AS quotes FROM (SELECT {G}, 'orders' AS k FROM mbo UNION ALL SELECT {G}, 'quotes' FROM truth) GROUP BY ROLLUP ({G})"))
def counts_rollup(spark, d):
    m, t = feeds(spark, d)
    return reports.counts_rollup({"orders": m, "quotes": t})


@register("duration_rate", o.query(o.given("mbo"), f"SELECT {G}, n, span_us, round(n * 1e6 / span_us, 9) AS rate, CAST(floor(n * 1e6 / span_us) AS BIGINT) AS rows_1s, round(5000.0::DOUBLE / (n * 1e6 / span_us), 6) AS seconds_5000 FROM (SELECT {G}, count(*) AS n, max(ts_us) - min(ts_us) AS span_us FROM mbo GROUP BY {G})"))
def duration_rate(spark, d):
    return reports.duration_rate(mbo(spark, d))


@register("rate_buckets", o.query(o.given("mbo"), f"SELECT {G}, bucket, count(*) AS n, round(count(*) / 1800.0::DOUBLE, 9) AS rate, strftime(make_timestamp(first_ + bucket * 1800000000), '%H:%M') AS starts FROM (SELECT *, (ts_us - first_) // 1800000000 AS bucket FROM (SELECT *, min(ts_us) OVER (PARTITION BY {G}) AS first_ FROM mbo)) GROUP BY {G}, bucket, first_"))
def rate_buckets(spark, d):
    return reports.rate_buckets(mbo(spark, d))


@register("dataset_size", o.query(o.given("mbo"), f"SELECT *, windows * 16000 AS bytes, CASE WHEN windows * 16000 <= 12000000000 THEN 'memory' WHEN windows * 16000 <= 32000000000 THEN 'half' ELSE 'stream' END AS fits FROM (SELECT {G}, count(*) AS n, count(*) // 4 AS windows FROM mbo GROUP BY {G})"))
def dataset_size(spark, d):
    return reports.dataset_size(mbo(spark, d))


@register("readiness", o.query([*o.given("mbo", "instruments", "calendar"), f"a AS (SELECT {G}, count(*) AS n FROM mbo GROUP BY {G})"], "SELECT i.ticker_id, c.day_id, coalesce(n, 0) AS n, coalesce(n, 0) > 3000 AS ready FROM instruments i CROSS JOIN calendar c LEFT JOIN a ON a.ticker_id = i.ticker_id AND a.day_id = c.day_id"))
def readiness(spark, d):
    expected = fixture(spark, d, "instruments").select("ticker_id").crossJoin(fixture(spark, d, "calendar").select("day_id"))
    return reports.readiness(mbo(spark, d), expected, 3000)


@register("preflight", o.query([*LABELLED, *o.given("instruments", "calendar"), f"lc AS (SELECT {G}, count(*) AS n, count(*) FILTER (WHERE label <> -1) AS labels FROM lb GROUP BY {G})", "ex AS (SELECT i.ticker_id, k AS day_id FROM instruments i, range(0, 40) r(k))"],
    """SELECT ex.ticker_id, ex.day_id, coalesce(n, 0) AS n, CAST(0 AS BIGINT) AS misshapen, coalesce(labels, 0) AS labels,
    CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n <= 40 THEN 'rows' WHEN labels <= 35 THEN 'labels' ELSE 'ready' END AS verdict FROM ex LEFT JOIN lc ON lc.ticker_id = ex.ticker_id AND lc.day_id = ex.day_id"""))  # fmt: skip
def preflight(spark, d):
    rows = labelled(spark, d)
    expected = fixture(spark, d, "instruments").select("ticker_id").crossJoin(spark.range(40).select(F.col("id").cast("int").alias("day_id")))
    return reports.preflight(features.features40(levels(snap(spark, d))), rows, expected, least=40, least_labels=35)


# --- labels --------------------------------------------------------------------------------------


@register("session_filter", o.query(o.given("snap"), f"SELECT {G}, seq FROM snap"))
def session_filter(spark, d):
    return snap(spark, d).select(*GROUP, "seq")


@register("mid_price", o.query(o.given("snap"), f"SELECT {G}, seq, round((b0 + a0) / 20000.0::DOUBLE, 9) AS mid, round(CAST(a0 - b0 AS DOUBLE) / 10000.0::DOUBLE / ((b0 + a0) / 20000.0::DOUBLE), 9) AS spread FROM snap"))
def mid_price(spark, d):
    return snap(spark, d).select(*GROUP, "seq", F.round(labels.mid_price(), 9).alias("mid"), F.round(labels.relative_spread(), 9).alias("spread"))


@register("forward_return", o.query(SNAP, f"SELECT {G}, seq, round(ret, 9) AS ret FROM fr"))
def forward_return(spark, d):
    return returned(spark, d).select(*GROUP, "seq", F.round("ret", 9).alias("ret"))


@register("double_alpha", o.query([*SNAP, o.alphas([0.22])], "SELECT round(alpha_down, 9) AS alpha_down, round(alpha_up, 9) AS alpha_up, n, round(abs(alpha_down - alpha_up) / mean_abs, 9) AS asymmetry FROM al"))
def double_alpha(spark, d):
    return pooled_alphas(spark, d).select(F.round("alpha_down", 9).alias("alpha_down"), F.round("alpha_up", 9).alias("alpha_up"), "n", F.round("asymmetry", 9).alias("asymmetry"))


@register("thresholds_stored", o.query([*SNAP, o.alphas([0.22])], "SELECT round(alpha_down, 9) AS alpha_down, round(alpha_up, 9) AS alpha_up, n FROM al"))
def thresholds_stored(spark, d):
    """Fitted and stored by the first call, read by the second."""
    path = f"{scratch_folder(spark, 'thresholds')}/alphas"
    for _ in range(2):
        alphas = datasets.fitted_thresholds(spark, path, lambda: pooled_alphas(spark, d))
    return alphas.select(F.round("alpha_down", 9).alias("alpha_down"), F.round("alpha_up", 9).alias("alpha_up"), "n")


@register("percentile_at_scale", o.query(SNAP, "SELECT round(quantile_cont(ret, 0.78::DOUBLE), 9) AS value FROM fr"))
def percentile_at_scale(spark, d):
    return labels.percentile_at_scale(returned(spark, d), "ret", 0.78).select(F.round("value", 9).alias("value"))


@register("labels_fixed", o.query(LABELLED, f"SELECT {G}, seq, label FROM lb"))
def labels_fixed(spark, d):
    return labelled(spark, d).select(*GROUP, "seq", "label")


@register("label_distribution", o.query(LABELLED, f"SELECT {G}, count(*) AS n, {', '.join(f'round(count(*) FILTER (WHERE label = {i}) / count(*)::DOUBLE, 9) AS {c}' for i, c in enumerate(('down', 'flat', 'up')))} FROM lb WHERE label <> -1 GROUP BY GROUPING SETS (({G}), ())"))
def label_distribution(spark, d):
    return labels.label_distribution(labelled(spark, d))


SPREAD = f"hs AS (SELECT {G}, median(CAST(a0 - b0 AS DOUBLE) / 10000.0::DOUBLE / ((b0 + a0) / 20000.0::DOUBLE)) / 2 AS half_spread FROM snap GROUP BY {G})"


@register("half_spread", o.query([*o.given("snap"), SPREAD], f"SELECT {G}, round(half_spread, 12) AS half_spread FROM hs"))
def half_spread(spark, d):
    return labels.half_spread(snap(spark, d)).select(*GROUP, F.round("half_spread", 12).alias("half_spread"))


_ROUND = "round(alpha_down, 9) AS alpha_down, round(alpha_up, 9) AS alpha_up"
_SHARES = "count(*) AS n, round(count(*) FILTER (WHERE ret < -alpha_down) / count(*)::DOUBLE, 9) AS down, round(count(*) FILTER (WHERE ret >= -alpha_down AND ret <= alpha_up) / count(*)::DOUBLE, 9) AS flat, round(count(*) FILTER (WHERE ret > alpha_up) / count(*)::DOUBLE, 9) AS up"


@register("tail_sweep_single", o.query([*SNAP, o.alphas([t / 100 for t in TAILS], G), SPREAD, f"sw AS (SELECT fr.ticker_id, fr.day_id, tail, alpha_down, alpha_up, mean_abs, {_SHARES} FROM fr JOIN al ON {o.same('fr', 'al')} WHERE ret IS NOT NULL GROUP BY fr.ticker_id, fr.day_id, tail, alpha_down, alpha_up, mean_abs)"],
    f"SELECT sw.ticker_id, sw.day_id, tail, {_ROUND}, round(abs(alpha_down - alpha_up) / mean_abs, 6) AS asymmetry, n, down, flat, up, alpha_down > half_spread AND alpha_up > half_spread AS ok FROM sw JOIN hs ON {o.same('sw', 'hs')}"))
def tail_sweep_single(spark, d):
    out = labels.tail_sweep(returned(spark, d), TAILS)
    return out.select(*GROUP, "tail", F.round("alpha_down", 9).alias("alpha_down"), F.round("alpha_up", 9).alias("alpha_up"), F.round("asymmetry", 6).alias("asymmetry"), "n", "down", "flat", "up", "ok")


@register("tail_sweep_multi", o.query([*SNAP, o.alphas([t / 100 for t in POOLED])], f"SELECT {G}, tail, {_ROUND}, {_SHARES.replace('count(*) AS n', 'count(*) AS n')} FROM (SELECT fr.*, tail, alpha_down, alpha_up FROM fr, al WHERE ret IS NOT NULL) GROUP BY {G}, tail, alpha_down, alpha_up"))
def tail_sweep_multi(spark, d):
    out = labels.tail_sweep_pooled(returned(spark, d), POOLED)
    return out.select(*GROUP, "tail", F.round("alpha_down", 9).alias("alpha_down"), F.round("alpha_up", 9).alias("alpha_up"), "n", "down", "flat", "up")


ATR = 10_800_000_000


@register("labels_atr", o.query([*SNAP, f"ad AS (SELECT *, abs(m2 - lag(m2) OVER (PARTITION BY {G} ORDER BY ts_us, seq)) AS dd FROM fr)",
    f"aw AS (SELECT *, count(*) OVER w AS k, sum(dd) OVER w - coalesce(first_value(dd) OVER w, 0) AS t FROM ad WINDOW w AS (PARTITION BY {G} ORDER BY ts_us RANGE BETWEEN {ATR} PRECEDING AND 1 PRECEDING))",
    "am AS (SELECT *, CASE WHEN ret IS NOT NULL AND k >= 10 AND k - 1 >= 5 THEN CAST(t AS DOUBLE) / (k - 1) END AS mean FROM aw)"],
    f"SELECT {G}, seq, " + ", ".join(f"CAST(CASE WHEN mean IS NULL THEN -1 WHEN ret < -mean / {by} THEN 0 WHEN ret > mean / {by} THEN 2 ELSE 1 END AS INT) AS {name}" for by, name in (("20000.0::DOUBLE", "label"), ("m2", "label_rel"))) + " FROM am"))
def labels_atr(spark, d):
    return labels.label_atr(returned(spark, d), window_us=ATR).select(*GROUP, "seq", "label", "label_rel")


THIN = 900_000_000  # so long a sample that windows of over 23 rows are thinned


@register("labels_atr_thinned", o.query([*SNAP, f"""aw AS (SELECT a.ticker_id, a.day_id, a.seq, a.ret, a.m2, list(b.m2 ORDER BY b.ts_us, b.seq) FILTER (WHERE b.m2 IS NOT NULL) AS w
    FROM fr a LEFT JOIN fr b ON {o.same('a', 'b')} AND b.ts_us >= a.ts_us - {ATR} AND b.ts_us < a.ts_us GROUP BY a.ticker_id, a.day_id, a.seq, a.ret, a.m2)""",
    f"ak AS (SELECT *, coalesce(len(w), 0) AS n, CAST(greatest(1, floor(coalesce(len(w), 0) * {THIN}::DOUBLE / {ATR})) AS BIGINT) AS k FROM aw)",
    "au AS (SELECT *, list_filter(w, lambda x, i: (i - 1) % k = 0) AS u FROM ak)",
    "am AS (SELECT *, CASE WHEN ret IS NOT NULL AND n >= 10 AND len(u) > 5 THEN CAST(list_sum(list_transform(u[2:], lambda x, i: abs(x - u[i]))) AS DOUBLE) / (len(u) - 1) END AS mean FROM au)"],
    f"SELECT {G}, seq, k AS step, " + ", ".join(f"CAST(CASE WHEN mean IS NULL THEN -1 WHEN ret < -mean / {by} THEN 0 WHEN ret > mean / {by} THEN 2 ELSE 1 END AS INT) AS {name}" for by, name in (("20000.0::DOUBLE", "label"), ("m2", "label_rel"))) + " FROM am"))
def labels_atr_thinned(spark, d):
    return labels.label_atr(returned(spark, d), window_us=ATR, sample_us=THIN).select(*GROUP, "seq", F.col("step"), "label", "label_rel")


# --- features ------------------------------------------------------------------------------------

FEATURES = f"""ft AS MATERIALIZED (SELECT {G}, seq, ts_us, CAST(l AS INT) * 4 + c AS f, CASE c WHEN 0 THEN a0 + l WHEN 1 THEN b0 - l WHEN 2 THEN 100 + (seq*11 + l*17) % 500 ELSE 100 + (seq*7 + l*13) % 500 END AS x,
    CASE WHEN c < 2 THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END AS unit FROM snap, range(10) t(l), (VALUES (0), (1), (2), (3)) u(c))"""


@register("features40", o.query([*o.given("snap"), FEATURES], f"SELECT {G}, seq, f, round(x / unit, 9) AS x FROM ft"))
def features40(spark, d):
    out = features.features40(levels(snap(spark, d)))
    return out.select(*GROUP, "seq", F.posexplode("x").alias("f", "x")).withColumn("x", F.round("x", 9))


_FLAT = {"bid_px": "(b0 - {i}) / 10000.0::DOUBLE", "bid_sz": "(100 + (seq*7 + {i}*13) % 500)::DOUBLE", "ask_px": "(a0 + {i}) / 10000.0::DOUBLE", "ask_sz": "(100 + (seq*11 + {i}*17) % 500)::DOUBLE"}


@register("flattened", o.query(o.given("snap"), f"SELECT {G}, seq, ts_us / 1e6 AS time, " + ", ".join(f"{sql.format(i=i)} AS {c}_{i}" for c, sql in _FLAT.items() for i in range(10)) + " FROM snap"))
def flattened(spark, d):
    return features.flattened(levels(snap(spark, d)))


@register("zscore", o.query([*o.given("snap"), FEATURES,
    f"fo AS (SELECT *, row_number() OVER (PARTITION BY {G}, f ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY {G}, f) AS n FROM ft)",
    f"""zw AS (SELECT a.ticker_id, a.day_id, a.seq, a.f, a.x, a.unit, sum(b.x - a.x) AS s1, sum((b.x - a.x) * (b.x - a.x)) AS s2 FROM (SELECT fo.*, greatest(0, least(n - 1, i + o)) AS j FROM fo, range(-5, 5) r(o)) a
    JOIN fo b ON {o.same('a', 'b')} AND a.f = b.f AND a.j = b.i GROUP BY a.ticker_id, a.day_id, a.seq, a.f, a.x, a.unit)"""],
    f"SELECT {G}, seq, f, round(-CAST(s1 AS DOUBLE) / 10 / unit / sqrt(greatest(CAST(s2 * 10 - s1 * s1 AS DOUBLE) / 100 / (unit * unit), 1e-8)), 6) AS z FROM zw"))
def zscore(spark, d):
    out = features.zscore(levels(snap(spark, d)), 10)
    return out.select(*GROUP, "seq", F.posexplode("z").alias("f", "z")).withColumn("z", F.round("z", 6))


@register("interarrival_norm", o.query([*o.given("snap"), f"g AS (SELECT {G}, seq, ts_us, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY {G} ORDER BY ts_us, seq), 0) / 1e6 AS gap FROM snap)"], f"SELECT {G}, seq, round(gap / (max(gap) OVER (PARTITION BY {G}) + 1e-8), 9) AS gap FROM g"))
def interarrival_norm(spark, d):
    return features.interarrival(snap(spark, d), GROUP).select(*GROUP, "seq", F.round("gap", 9).alias("gap"))


@register("sliding_windows", o.query([*LABELLED, f"vr AS (SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY {G}) AS n FROM lb WHERE label <> -1)", f"wn AS (SELECT {G}, i // 4 AS win FROM vr WHERE i % 4 = 0 AND i + 10 <= n)"],
    f"SELECT w.ticker_id, w.day_id, win AS window, v.i - win * 4 AS pos, v.seq, e.label AS y FROM wn w JOIN vr v ON {o.same('w', 'v')} AND v.i >= win * 4 AND v.i < win * 4 + 10 JOIN vr e ON {o.same('w', 'e')} AND e.i = win * 4 + 9"))
def sliding_windows(spark, d):
    rows = labelled(spark, d).where("label <> -1")
    out = features.sliding_windows(rows, ["seq"], 10, 4, "label")
    return out.select(*GROUP, "window", "y", F.posexplode("x").alias("pos", "seq")).withColumn("pos", F.col("pos").cast("long"))


Z_SUM = [
    f"big AS MATERIALIZED (SELECT snap.* FROM snap JOIN (SELECT {G} FROM snap GROUP BY {G} HAVING count(*) >= 20) g ON {o.same('snap', 'g')})",
    FEATURES.replace("FROM snap,", "FROM big,"),
    f"fo AS (SELECT *, row_number() OVER (PARTITION BY {G}, f ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY {G}, f) AS n FROM ft)",
    f"""zw AS (SELECT a.ticker_id, a.day_id, a.seq, a.f, a.x, a.unit, sum(b.x - a.x) AS s1, sum((b.x - a.x) * (b.x - a.x)) AS s2 FROM (SELECT fo.*, greatest(0, least(n - 1, i + o)) AS j FROM fo, range(-5, 5) r(o)) a
    JOIN fo b ON {o.same('a', 'b')} AND a.f = b.f AND a.j = b.i GROUP BY a.ticker_id, a.day_id, a.seq, a.f, a.x, a.unit)""",
    f"zs AS (SELECT {G}, seq, sum(-CAST(s1 AS DOUBLE) / 10 / unit / sqrt(greatest(CAST(s2 * 10 - s1 * s1 AS DOUBLE) / 100 / (unit * unit), 1e-8))) AS total FROM zw GROUP BY {G}, seq)",
    "snap_fit AS (SELECT * FROM snap WHERE day_id % 3 <> 2)", *o.returns(H, "snap_fit", "ff"), o.alphas([0.22], source="ff"), *o.returns(H, "big"),
    "lb AS (SELECT fr.*, CAST(CASE WHEN ret IS NULL THEN -1 WHEN ret < -alpha_down THEN 0 WHEN ret > alpha_up THEN 2 ELSE 1 END AS INT) AS label FROM fr, al)",
    f"vz AS (SELECT zs.*, label, row_number() OVER (PARTITION BY zs.ticker_id, zs.day_id ORDER BY zs.seq) - 1 AS i, count(*) OVER (PARTITION BY zs.ticker_id, zs.day_id) AS n FROM zs JOIN lb ON {o.same('zs', 'lb')} AND zs.seq = lb.seq WHERE label <> -1)",
    "vr AS MATERIALIZED (SELECT * FROM vz WHERE n >= 20)",
]


@register("labelled_features", o.query([*o.given("snap"), *Z_SUM], f"SELECT {G}, seq, label, round(total, 3) AS total FROM vr"))
def labelled_features(spark, d):
    """Features and labels without windows, of all days."""
    out = datasets.labelled_features(*windows_input(spark, d), H, 10, 20)
    return out.select(*GROUP, "seq", "label", F.round(F.aggregate("z", F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


@register("windows_dataset", o.query([*o.given("snap"), *Z_SUM], f"""SELECT w.ticker_id, w.day_id, w.i // 4 AS window, any_value(e.label) AS y, CAST(count(*) AS INT) AS rows, round(sum(v.total), 3) AS total FROM vr w JOIN vr v ON {o.same('w', 'v')} AND v.i >= w.i AND v.i < w.i + 10
    JOIN vr e ON {o.same('w', 'e')} AND e.i = w.i + 9 WHERE w.i % 4 = 0 AND w.i + 10 <= w.n GROUP BY w.ticker_id, w.day_id, w.i"""))  # fmt: skip
def windows_dataset(spark, d):
    out = windows(spark, d)
    return out.select(*GROUP, "window", "y", F.size("x").alias("rows"), F.round(F.aggregate(F.flatten("x"), F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


def windows_input(spark, d, split: str | None = None):
    """(snapshots of a split, thresholds of the training days)."""
    snaps = fixture(spark, d, "snap_all")
    if split is not None:
        snaps = snaps.where(F.col("day_id") % 3 == 2 if split == "test" else F.col("day_id") % 3 != 2)
    alphas = labels.thresholds(labels.forward_return(labels.session_filter(fixture(spark, d, "snap_all").where("day_id % 3 <> 2")), H), [0.22])
    return levels(snaps).join(snaps.select(*GROUP, "seq", "b0", "a0"), [*GROUP, "seq"]), alphas


def windows(spark, d, split: str | None = None):
    return datasets.windows_dataset(*windows_input(spark, d, split), H, 10, 10, 4, 20)


@register("chronological_split", o.query(o.given("snap"), f"SELECT {G}, seq, i AS index, CASE WHEN i < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train' ELSE 'valid' END AS part FROM (SELECT *, row_number() OVER (ORDER BY {G}, seq) - 1 AS i, count(*) OVER () AS n FROM snap)"))
def chronological_split(spark, d):
    return datasets.chronological_split(snap(spark, d).select(*GROUP, "seq"), 0.2)


@register("holdout_day", o.query(o.given("snap"), f"SELECT {G}, n, CASE WHEN day_id = max(day_id) OVER (PARTITION BY ticker_id) THEN 'valid' ELSE 'train' END AS part FROM (SELECT {G}, count(*) AS n FROM snap GROUP BY {G}) WHERE n >= 20"))
def holdout_day(spark, d):
    return datasets.holdout_day(snap(spark, d), 20)


@register("split_membership", o.query(o.given("mbo", "calendar"), f"SELECT {G}, count(*) AS n FROM mbo WHERE day_id IN (SELECT day_id FROM calendar WHERE split = 'train') GROUP BY {G}"))
def split_membership(spark, d):
    return datasets.split_membership(mbo(spark, d), fixture(spark, d, "calendar"), "train").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))


# --- weights, samples, metrics -------------------------------------------------------------------

WEIGHTS = "cw AS (SELECT label, n, 1.0::DOUBLE / (n / (sum(n) OVER ())::DOUBLE + 1e-8) AS weight FROM (SELECT label, count(*) AS n FROM lb WHERE label <> -1 GROUP BY label))"


@register("class_weights", o.query([*LABELLED, WEIGHTS], "SELECT label, n, round(weight, 9) AS weight, round(weight / sum(weight) OVER () * count(*) OVER (), 9) AS normalised FROM cw"))
def class_weights(spark, d):
    out = datasets.class_weights(labelled(spark, d).where("label <> -1"))
    return out.withColumns({"weight": F.round("weight", 9), "normalised": F.round("normalised", 9)})


@register("sample_weights", o.query([*LABELLED, WEIGHTS], f"SELECT {G}, seq, round(weight, 9) AS weight FROM lb JOIN cw USING (label)"))
def sample_weights(spark, d):
    return datasets.sample_weights(labelled(spark, d).where("label <> -1")).select(*GROUP, "seq", F.round("weight", 9).alias("weight"))


@register("balanced_sample", o.query([*LABELLED, WEIGHTS, f"bi AS (SELECT {G}, seq, label, row_number() OVER (ORDER BY label, {G}, seq) - 1 AS i FROM lb WHERE label <> -1)",
    "bc AS (SELECT label, min(i) AS first_, any_value(weight) * count(*) AS chance, count(*) AS n FROM bi JOIN cw USING (label) GROUP BY label)",
    "bb AS (SELECT *, sum(chance) OVER (ORDER BY label) / sum(chance) OVER () AS hi, coalesce(sum(chance) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(chance) OVER (), 0) AS lo FROM bc)",
    "dr AS (SELECT id AS draw, CAST('0x' || substr(md5('7:1:' || id), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS u, CAST('0x' || substr(md5('7:2:' || id), 1, 10) AS BIGINT) / 1099511627776.0::DOUBLE AS v FROM (SELECT unnest(range((SELECT count(*) FROM bi))) AS id))",
    "di AS (SELECT draw, first_ + CAST(floor(v * n) AS BIGINT) AS i FROM dr JOIN bb ON u >= lo AND (u < hi OR hi >= 1))"],
    f"SELECT draw, {G}, seq, label FROM di JOIN bi USING (i)"))
def balanced_sample(spark, d):
    rows = labelled(spark, d).where("label <> -1").select(*GROUP, "seq", "label")
    return datasets.balanced_sample(rows, rows.count(), [*GROUP, "seq"])


@register("confusion", o.query(o.given("preds"), "SELECT label, pred, count(*) AS n FROM preds GROUP BY label, pred"))
def confusion(spark, d):
    return models.confusion(fixture(spark, d, "preds"))


_RECALL = ", ".join(f"round(coalesce(count(*) FILTER (WHERE label = {c} AND pred = {c}) / nullif(count(*) FILTER (WHERE label = {c}), 0)::DOUBLE, 0), 9) AS recall_{c}" for c in range(3))


@register("class_recall", o.query(o.given("preds"), f"SELECT count(*) AS n, round(count(*) FILTER (WHERE label = pred) / count(*)::DOUBLE, 9) AS accuracy, {_RECALL} FROM preds"))
def class_recall(spark, d):
    return models.accuracy_recall(fixture(spark, d, "preds"), [0, 1, 2])


@register("mean_loss", o.query(o.given("preds"), "SELECT day_id, count(*) AS n, round(avg(-ln(CASE WHEN label = pred THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END)), 9) AS loss FROM preds GROUP BY ROLLUP (day_id)"))
def mean_loss(spark, d):
    p = fixture(spark, d, "preds")
    out = models.mean_loss(p, models.log_loss(F.when(F.col("label") == F.col("pred"), 0.7).otherwise(0.1)), "day_id")
    return out.withColumn("loss", F.round("loss", 9))


@register("epoch_order", o.query(o.given("snap"), "SELECT epoch, day_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || day_id)) AS place FROM (SELECT DISTINCT day_id FROM snap), range(3) r(epoch)"))
def epoch_order(spark, d):
    return datasets.epoch_order(snap(spark, d).select("day_id").distinct(), 3).select("epoch", "day_id", "place")


# --- streams, files, models ----------------------------------------------------------------------


PIECE = 500_000  # messages of a group in a micro-batch, at most: what a task holds doesn't grow with the day


def longest(rows) -> int:
    return rows.groupBy(*GROUP).count().agg(F.max("count")).first()[0] or 1


def pieces_of(m) -> int:
    """Into how many pieces the longest day is cut: four at least."""
    return max(4, -(-longest(m) // PIECE))


def followed(spark, path: str, kind: str, rows, pieces: int):
    """The record files of a folder as a stream that replays them in about ``pieces`` pieces."""
    return keyed(fixedrec.follow_fixed(spark, path, kind, rows_per_file=-(-longest(rows) // pieces), fresh=True))


def feed_stream(spark, d):
    m, folder = mbo(spark, d), scratch_folder(spark, "feed")
    return followed(spark, feed_folder(m, f"{folder}/orders"), "orders", m, pieces_of(m)), folder


@register("live_book", BBO_SQL)
def live_book(spark, d):
    rows = live.book_rows(*feed_stream(spark, d), tells=[*live.TIMED, *live.BEST])
    return live.best_of(rows).select(*GROUP, "seq", "bid_px", "ask_px")


@register("live_accuracy", o.query([*MT, *o.ALL, *o.COMPARED], f"SELECT {G}, count(*) FILTER (WHERE {o.HIT}) AS matched, count(*) FILTER (WHERE NOT {o.HIT}) AS failed, round(100.0::DOUBLE * count(*) FILTER (WHERE {o.HIT}) / count(*), 9) AS accuracy FROM cmp GROUP BY {G}"))
def live_accuracy(spark, d):
    """Messages and quotes as two streams; quotes come a third faster, so that few messages wait for theirs."""
    folder, (m, t) = scratch_folder(spark, "check"), feeds(spark, d)
    pieces = pieces_of(m)
    sent = followed(spark, feed_folder(m, f"{folder}/orders"), "orders", m, pieces)
    told = followed(spark, quote_folder(t, f"{folder}/truth"), "truth", t, pieces * 3 // 4)
    return live.live_accuracy(sent, told, folder)


@register("recorder", o.query(o.given("mbo"), f"SELECT {G}, count(*) AS n, max(seq) AS last FROM (SELECT {G}, seq, coalesce(last_value(CASE WHEN NOT (price >= 10000000 OR (event_type = 1 AND price = 0)) THEN ts_us END IGNORE NULLS) OVER (PARTITION BY {G} ORDER BY seq), 0) AS s FROM mbo) WHERE s >= 1000000 GROUP BY {G}"))
def recorder(spark, d):
    snaps = live.live_book(*feed_stream(spark, d))[0]
    return live.recorded(snaps).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


@register("live_rates", o.query(o.given("mbo"), f"SELECT *, round(n / 1800.0::DOUBLE, 9) AS rate FROM (SELECT {G}, ts_us - ts_us % 1800000000 AS starts_us, count(*) AS n FROM mbo GROUP BY ALL)"))
def live_rates(spark, d):
    """Message rates by half hour of the clock, of the feed as a stream."""
    return live.live_rates(*feed_stream(spark, d))


LATE = f"""SELECT {G}, CAST(count(*) FILTER (WHERE seq < top) AS BIGINT) AS late FROM (SELECT *, max(CASE WHEN seq % 4 <> 0 THEN seq END) OVER (PARTITION BY {G}) AS top FROM mbo)
    WHERE seq % 4 = 0 GROUP BY {G} HAVING count(*) FILTER (WHERE seq < top) > 0"""


def late_feed(spark, d, late: str, tells: list[str]):
    """Every fourth message comes after all others, with its number; the stream is stopped in between and goes on from its checkpoint.

    All messages are folded; of the snapshots only the columns ``tells`` are written.
    """
    m, folder = mbo(spark, d), scratch_folder(spark, "late")
    for i, part in enumerate(("seq % 4 <> 0", "seq % 4 = 0")):
        steps = arrivals(m.where(part), f"{folder}/part{i}", f"{folder}/in", PIECE)
        rows = live.book_rows(spark.readStream.schema(m.schema).parquet(f"{folder}/in"), folder, late, arrivals=steps, tells=tells)
    return rows


@register("late_messages", o.query(o.given("mbo"), LATE))
def late_messages(spark, d):
    return live.late_counts(live.late_of(late_feed(spark, d, "apply", [])))


@register("late_messages_drop", o.query(o.given("mbo"), LATE))
def late_messages_drop(spark, d):
    return live.late_counts(live.late_of(late_feed(spark, d, "drop", [])))


ON_TIME = f"feed AS (SELECT * EXCLUDE (top) FROM (SELECT *, max(CASE WHEN seq % 4 <> 0 THEN seq END) OVER (PARTITION BY {G}) AS top FROM mbo) WHERE seq % 4 <> 0 OR seq > top)"


@register("late_book_drop", o.query([*o.given("mbo"), ON_TIME, *o.BBO], f"SELECT {G}, seq, bid_px, ask_px FROM bb"))
def late_book_drop(spark, d):
    """The best prices where late messages are left out."""
    return live.best_of(late_feed(spark, d, "drop", [*live.TIMED, *live.BEST])).select(*GROUP, "seq", "bid_px", "ask_px")


HELD_BACK = 120


@register("reordered_book", BBO_SQL)
def reordered_book(spark, d):
    """A feed that comes in two parts, of which the first lacks every fourth of the last messages before the cut, put in order."""
    m, folder = mbo(spark, d), scratch_folder(spark, "reordered")
    middle = m.groupBy(*GROUP).agg(F.floor(F.max("seq") / 2).alias("middle"))  # one row a group
    cut = m.join(middle, GROUP)
    early = (F.col("seq") <= F.col("middle")) & ~((F.col("seq") % 4 == 0) & (F.col("seq") > F.col("middle") - HELD_BACK // 2))
    for i, part in enumerate((early, ~early)):
        steps = arrivals(cut.where(part).drop("middle"), f"{folder}/part{i}", f"{folder}/in", PIECE)
        found = live.live_book(spark.readStream.schema(m.schema).parquet(f"{folder}/in"), folder, hold=HELD_BACK, arrivals=steps)
    return found[1].select(*GROUP, "seq", "bid_px", "ask_px")


@register("fixedrec_files", o.query(o.given("mbo"), f"SELECT 'mbo_' || ticker_id || '_' || day_id || '.bin' AS file, seq, ts_us, event_type, order_id, size, price, direction FROM mbo"))
def fixedrec_files(spark, d):
    """One file of order records a group, written to the shared folder and read again."""
    return fixedrec.read_fixed(spark, feed_folder(mbo(spark, d), scratch_folder(spark, "records")), "orders")


@register("truth_files", o.query(MT, f"SELECT 'truth_' || ticker_id || '_' || day_id || '.bin' AS file, row_number() OVER (PARTITION BY {G} ORDER BY tseq) AS seq, ts_us, bid_px, bid_sz, ask_px, ask_sz FROM truth"))
def truth_files(spark, d):
    """One file of quote records a group."""
    return fixedrec.read_fixed(spark, quote_folder(feeds(spark, d)[1], scratch_folder(spark, "quotes")), "truth")


@register("snapshot_files", o.query(o.given("snap"), f"""SELECT 'snap_' || ticker_id || '_' || day_id || '.bin' AS file, row_number() OVER (PARTITION BY {G}, l ORDER BY seq) AS seq, ts_us, l AS level, b0 - l AS bid_px, 100 + (seq*7 + l*13) % 500 AS bid_sz, a0 + l AS ask_px, 100 + (seq*11 + l*17) % 500 AS ask_sz FROM snap, range(10) t(l)"""))
def snapshot_files(spark, d):
    """One file of ten-level records a group, read in ranges of 100 records, a row for each level."""
    folder = scratch_folder(spark, "snapshots")
    fixedrec.write_records(levels(snap(spark, d)), folder, "snapshots", GROUP, "snap_{}_{}.bin")
    rows = fixedrec.read_fixed(spark, folder, "snapshots", partition_bytes=24_800)
    level = F.posexplode(F.arrays_zip("bid_px", "bid_sz", "ask_px", "ask_sz")).alias("level", "v")
    return rows.select("file", "seq", "ts_us", level).select("file", "seq", "ts_us", F.col("level").cast("long").alias("level"), "v.*")


@register("snapshot_table", o.query([*MTG, *o.BBO], f"SELECT {G}, count(*) AS n, max(seq) AS last, sum(bid_px) AS bids, sum(ask_px) AS asks FROM bb GROUP BY {G}"))
def snapshot_table(spark, d):
    """The snapshots of gated days, written one directory a group and read again with their best prices as columns."""
    folder = scratch_folder(spark, "table")
    snaps, _, n = stored(spark, d)
    sinks.write_partitioned(sinks.with_top_columns(snaps), folder, n_rows=n)
    rows = spark.read.parquet(folder).groupBy(*GROUP)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.sum("b0").alias("bids"), F.sum("a0").alias("asks"))


@register("split_tables", o.query(o.given("mbo", "calendar"), "SELECT ticker_id, split, count(*) AS n, count(DISTINCT mbo.day_id) AS days FROM mbo JOIN calendar USING (day_id) GROUP BY ticker_id, split"))
def split_tables(spark, d):
    """Days put together by ticker and split, and read again."""
    folder = scratch_folder(spark, "splits")
    datasets.concatenated(mbo(spark, d), fixture(spark, d, "calendar"), folder)
    return spark.read.parquet(folder).groupBy("ticker_id", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day_id").alias("days"))


@register("fixedrec_roundtrip", o.query(o.given("mbo"), f"SELECT CAST(ticker_id AS BIGINT) * 1000000000 + CAST(day_id AS BIGINT) * 100000000 + seq AS seq, ts_us, event_type, order_id, size, price, direction FROM mbo"))
def fixedrec_roundtrip(spark, d):
    rows = mbo(spark, d).withColumn("seq", F.col("ticker_id") * F.lit(1_000_000_000).cast("long") + F.col("day_id") * 100_000_000 + F.col("seq"))
    return fixedrec.decoded(fixedrec.encoded(rows, "orders"), "orders")


@register("train_classifier")
def train_classifier(spark, d):
    model = models.train(models.summarised(windows(spark, d, "train"), GROUP))
    out = models.scored(model, models.summarised(windows(spark, d, "test"), GROUP), GROUP)
    return models.accuracy_recall(out, [0, 1, 2]).withColumn("metric", F.lit("test"))


@register("score_windows")
def score_windows(spark, d):
    """The chance of a rise that the classifier fitted on the training days gives each window of the others."""
    model = models.train(models.summarised(windows(spark, d, "train"), GROUP))
    rows = windows(spark, d, "test").select(*GROUP, "window", F.flatten("x").alias("all"))
    return models.batch_scored(rows, models.window_scorer(model, 10, labels.UP), "all", 10 * features.WIDTH).select(*GROUP, "window", "score")
