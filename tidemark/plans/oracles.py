"""SQL pieces for the comparison queries."""

from __future__ import annotations

from tidemark.sources import fixtures

G = "ticker_id, day_id"


def same(a: str, b: str) -> str:
    return f"{a}.ticker_id = {b}.ticker_id AND {a}.day_id = {b}.day_id"


def given(*names: str) -> list[str]:
    """Fixtures as common table expressions; later ones read earlier ones by name."""
    out = []
    for name in names:
        sql = fixtures.ORACLE[name]
        if "mbo" in names:
            sql = sql.replace(f"({fixtures.MBO}) mbo", "mbo")
        if "truth" in names and name != "truth":
            sql = sql.replace(f"({fixtures.TRUTH}) truth", "truth")
        if "mbo_raw" in names:
            sql = sql.replace(f"({fixtures.MBO_RAW}) raw", "mbo_raw")
        out.append(f"{name} AS MATERIALIZED ({sql})")
    return out


def query(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


ALL = ["feed AS (SELECT * FROM mbo)"]
BOUNDS = [f"bd AS (SELECT {G}, min(ts_us) AS open_us, max(ts_us) AS close_us FROM truth GROUP BY {G})"]
GATED = [
    *BOUNDS,
    f"g0 AS (SELECT mbo.*, open_us, close_us, max(CAST(ts_us > close_us + 60000000 AS INT)) OVER (PARTITION BY mbo.ticker_id, mbo.day_id ORDER BY seq) AS over_ FROM mbo JOIN bd ON {same('mbo', 'bd')} WHERE ts_us >= open_us - 60000000)",
    "feed AS MATERIALIZED (SELECT * EXCLUDE (over_) FROM g0 WHERE over_ = 0)",
]
LIFE = [
    "v AS (SELECT * FROM feed WHERE NOT (price >= 10000000 OR (event_type = 1 AND price = 0)))",
    f"e AS (SELECT *, CAST(sum(CASE WHEN event_type = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {G}, order_id ORDER BY seq) AS BIGINT) AS epoch FROM v)",
    f"""l AS (SELECT *, first_value(price) OVER w AS price0, first_value(direction) OVER w AS dir0,
    CAST(CASE WHEN epoch = 0 OR max(CAST(event_type = 3 AS INT)) OVER w = 1 THEN 0 ELSE greatest(0, first_value(size) OVER w - sum(CASE WHEN event_type IN (2, 4) THEN size ELSE 0 END) OVER w) END AS BIGINT) AS remaining
    FROM e WINDOW w AS (PARTITION BY {G}, order_id, epoch ORDER BY seq))""",
]
DELTAS = [
    *LIFE,
    f"p AS (SELECT *, coalesce(lag(remaining) OVER o, 0) AS had, lag(price0) OVER o AS px1, lag(dir0) OVER o AS dir1 FROM l WINDOW o AS (PARTITION BY {G}, order_id ORDER BY seq))",
    f"""d AS MATERIALIZED (SELECT {G}, seq, dir1 AS side, px1 AS px, -had AS delta FROM p WHERE event_type = 1 AND had <> 0
    UNION ALL SELECT {G}, seq, dir0, price0, remaining FROM p WHERE event_type = 1 AND remaining <> 0
    UNION ALL SELECT {G}, seq, dir0, price0, remaining - had FROM p WHERE event_type <> 1 AND remaining <> had)""",
]
LEVELS = [
    *DELTAS,
    f"lv AS MATERIALIZED (SELECT {G}, side, px, seq, CAST(sum(delta) OVER (PARTITION BY {G}, side, px ORDER BY seq) AS BIGINT) AS volume FROM (SELECT {G}, side, px, seq, sum(delta) AS delta FROM d GROUP BY {G}, side, px, seq))",
    f"iv AS MATERIALIZED (SELECT *, coalesce(lead(seq) OVER (PARTITION BY {G}, side, px ORDER BY seq), 9223372036854775807) AS nxt FROM lv)",
]
STAB = f"iv ON {same('f', 'iv')} AND f.seq >= iv.seq AND f.seq < nxt AND volume > 0"
BBO = [
    *LEVELS,
    f"bb AS MATERIALIZED (SELECT f.ticker_id, f.day_id, f.seq, f.ts_us, coalesce(max(CASE WHEN side = 1 THEN px END), 0) AS bid_px, coalesce(min(CASE WHEN side <> 1 THEN px END), 0) AS ask_px FROM feed f LEFT JOIN {STAB} GROUP BY f.ticker_id, f.day_id, f.seq, f.ts_us)",
]
COMPARED = [
    *BBO,
    f"ft AS (SELECT {G}, arg_min(tseq, ts_us) AS s0, min(ts_us) AS u0, arg_min(bid_px, ts_us) AS b0, arg_min(ask_px, ts_us) AS a0 FROM truth GROUP BY {G})",
    f"""cmp AS MATERIALIZED (SELECT bb.*, coalesce(t.tseq, s0) AS tseq, coalesce(t.ts_us, u0) AS t_us, coalesce(t.bid_px, b0) AS t_bid, coalesce(t.ask_px, a0) AS t_ask
    FROM bb ASOF LEFT JOIN truth t ON {same('bb', 't')} AND bb.ts_us >= t.ts_us JOIN ft ON {same('bb', 'ft')})""",
]
HIT = "(bid_px = t_bid AND ask_px = t_ask)"
ACC = [
    *GATED, *COMPARED,
    f"""acc AS MATERIALIZED (SELECT cmp.ticker_id, cmp.day_id, count(*) FILTER (WHERE {HIT}) AS matched, count(*) FILTER (WHERE NOT {HIT}) AS failed,
    round(100.0::DOUBLE * count(*) FILTER (WHERE {HIT}) / count(*), 9) AS accuracy
    FROM cmp JOIN bd ON {same('cmp', 'bd')} WHERE cmp.ts_us BETWEEN open_us AND close_us GROUP BY cmp.ticker_id, cmp.day_id)""",
]
SNAP_TIME = f"""tm AS (SELECT {G}, seq, coalesce(last_value(CASE WHEN NOT (price >= 10000000 OR (event_type = 1 AND price = 0)) THEN ts_us END IGNORE NULLS) OVER (PARTITION BY {G} ORDER BY seq), 0) AS snap_us FROM feed)"""
STORED = [f"""sb AS MATERIALIZED (SELECT bb.*, CAST(max(snap_us) OVER (PARTITION BY bb.ticker_id, bb.day_id ORDER BY bb.seq) AS BIGINT) AS snap_us FROM bb JOIN tm ON {same('bb', 'tm')} AND bb.seq = tm.seq)"""]
NEAR = [
    *GATED, *BBO, SNAP_TIME, *STORED,
    "tz AS MATERIALIZED (SELECT * FROM truth_zero WHERE bid_px > 0 AND ask_px > 0)",
    f"bz AS (SELECT {G}, min(ts_us) AS open_us, max(ts_us) AS close_us FROM tz GROUP BY {G})",
    f"""nr AS (SELECT sb.* EXCLUDE (ts_us), sb.snap_us AS ts_us, t.tseq, t.ts_us AS t_us, t.bid_px AS t_bid, t.ask_px AS t_ask FROM sb ASOF JOIN tz t ON {same('sb', 't')} AND sb.snap_us >= t.ts_us
    JOIN bz ON {same('sb', 'bz')} WHERE sb.snap_us >= open_us - 1000000 AND sb.snap_us <= close_us + 1000000 AND sb.snap_us - t.ts_us < 5000
    UNION ALL SELECT sb.* EXCLUDE (ts_us), sb.snap_us AS ts_us, t.tseq, t.ts_us, t.bid_px, t.ask_px FROM sb JOIN bz ON {same('sb', 'bz')} JOIN tz t ON {same('sb', 't')} AND t.ts_us = open_us
    WHERE sb.snap_us < open_us AND sb.snap_us >= open_us - 1000000 AND open_us - sb.snap_us < 5000)""",
]


def returns(horizon_us: int, table: str = "snap", name: str = "fr") -> list[str]:
    return [
        f"{name}0 AS (SELECT *, b0 + a0 AS m2, sum(b0 + a0) OVER w AS s, count(*) OVER w AS c FROM {table} WINDOW w AS (PARTITION BY {G} ORDER BY ts_us RANGE BETWEEN {horizon_us} FOLLOWING AND {2 * horizon_us - 1} FOLLOWING))",
        f"{name} AS MATERIALIZED (SELECT *, CASE WHEN c > 0 AND m2 > 0 THEN CAST(s - c * m2 AS DOUBLE) / CAST(c * m2 AS DOUBLE) END AS ret FROM {name}0)",
    ]


def alphas(tails: list[float], by: str = "", name: str = "al", source: str = "fr") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    one = [f"SELECT {head}{t}::DOUBLE AS tail, abs(quantile_cont(ret, {t}::DOUBLE)) AS alpha_down, quantile_cont(ret, {1 - t}::DOUBLE) AS alpha_up, count(*) AS n, avg(CASE WHEN ret <> 0 THEN abs(ret) END) AS mean_abs FROM {source} WHERE ret IS NOT NULL {group}" for t in tails]
    return f"{name} AS (" + " UNION ALL ".join(one) + ")"
