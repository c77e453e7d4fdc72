"""What only large tables tell: results, partitions and memory that don't follow the size of a group."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.test_book import SCHEMA, Reads, feed, processor
from tidemark.operators import asof, book, ranks, validate
from tidemark.sources import fixtures, sinks
from tidemark.sources.fixtures import ORACLE, fixture
from tidemark.streaming import live


@pytest.fixture(scope="module")
def long_day(tmp_path_factory):
    """A table of which every row is a message of one day."""
    folder, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    con.execute(f"COPY (SELECT i // 4 * 20 AS l_orderkey, i * 7919 % 2000 AS l_partkey, i % 100 AS l_suppkey, CAST(i % 4 + 1 AS INT) AS l_linenumber, i % 50 + 1.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, TIMESTAMP '2020-01-01' + to_days(CAST(hash(i) % 2000 AS INT)) AS l_shipdate FROM range(558719) t(i)) TO '{folder}/lineitem.parquet'")
    return str(folder)


def test_messages_of_a_long_day_equal_the_sql(spark, long_day, tmp_path):
    """Times are shares of a day whose last digit depends on how a division is rounded."""
    fixture(spark, long_day, "mbo").write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{long_day}/lineitem.parquet'")
    con.execute(f"CREATE TABLE want AS {ORACLE['mbo']}")
    con.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    names = ", ".join(x[0] for x in con.execute("DESCRIBE want").fetchall())
    assert con.execute(f"SELECT count(*) FROM (SELECT {names} FROM want EXCEPT SELECT {names} FROM got)").fetchone()[0] == 0
    assert con.execute("SELECT (SELECT count(*) FROM want) - (SELECT count(*) FROM got)").fetchone()[0] == 0


def test_a_micro_batch_is_handed_on_in_chunks_and_reads_orders_by_bucket():
    """Snapshots aren't held until the micro-batch ends, and orders next to each other take one call."""
    fold, batch = processor()
    rows = [(i + 1, 2_000_000 + i, 1 + 3 * (i % 7 == 0), i % 6000, 5, 100 + i % 50, 1 if i % 2 else -1) for i in range(3 * live.ROWS)]
    chunks = [len(out) + len(late) for out, late in fold.folded(batch(rows))]
    assert sum(chunks) == len(rows) and max(chunks) <= live.ROWS
    assert fold.orders.reads == 2 and len(fold.orders) <= 2
    held = {}
    for seq, ts, event, oid, *change in rows:
        held[oid] = live.after(held.get(oid), event, *change)
    assert live.Orders(fold.orders, list(held)).before == held


def test_python_is_handed_packed_messages_and_gives_columns():
    """No row of a feed is converted on its own: neither what comes, nor the levels of a snapshot."""
    fold, batch = processor()
    rows = batch([(i + 1, 2_000_000 + i, 1 + 3 * (i % 7 == 0), i % 60, 5, 100 + i % 50, 1 if i % 2 else -1) for i in range(100)])
    want = processor()[0].fold(rows)[0]
    pieces = pd.DataFrame({"row_kind": 0, "rows": [rows[i : i + 30].to_numpy("int64").tobytes() for i in (60, 0, 90, 30)]})
    got = pd.concat(fold.handleInputRows((3, 4), iter([pieces[:1], pieces[1:]]), None))
    assert [c for c in got if got[c].dtype == object or str(got[c].dtype).startswith("str")] == ["kind"] and set(got["kind"]) == {"book"}
    assert got[live.FLAT].to_numpy().tolist() == [[*r[:3], *r[3], *r[4], *r[5], *r[6]] for r in want]
    late = next(fold.handleInputRows((3, 4), iter([pieces[:1]]), None))
    assert set(late["kind"]) == {"late"} and late["seq"].tolist() == list(range(61, 91))


def test_a_micro_batch_is_written_once_and_not_held(spark, tmp_path):
    rows = [(*r[:6], None if r[5] in (2, 3) else r[6], *r[7:]) for r in feed(5)]
    m = spark.createDataFrame(rows, SCHEMA)
    m.write.parquet(f"{tmp_path}/in")
    snaps, best, late = live.live_book(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/run")
    assert {x.name for x in (tmp_path / "run").iterdir()} == {"checkpoint", "book"} and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, book.bbo(book.snapshots(m)).collect())) and snaps.count() == len(rows) and late.isEmpty()


def test_pieces_of_a_feed_are_bounded(spark, tmp_path):
    """Every micro-batch has a bounded number of messages of a group, in order."""
    m = spark.range(1000).selectExpr("cast(id % 2 as int) as ticker_id", "0 as day_id", "id div 2 + 1 as seq", "id as ts_us", "1 as event_type", "id as order_id", "1 as size", "5L as price", "1 as direction")
    steps, sizes = fixtures.arrivals(m.where("seq % 4 <> 0"), f"{tmp_path}/aside", f"{tmp_path}/in", 100), []
    for bring in steps:
        bring()
        sizes.append(spark.read.parquet(f"{tmp_path}/in").agg({"seq": "max"}).first()[0])
    assert sizes == [99, 199, 299, 399, 499] and spark.read.parquet(f"{tmp_path}/in").count() == 750
    steps = fixtures.arrivals(m.withColumn("ts_us", m.ts_us + 2_000_000), f"{tmp_path}/other", f"{tmp_path}/late", 100)
    _, best, late = live.live_book(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/late"), f"{tmp_path}/run", arrivals=steps)
    assert best.count() == 1000 and late.count() == 0


def sorts(df):
    """How many sorts a plan has, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [")


def test_orders_and_levels_are_sorted_once(spark):
    """Windows of one order share a sort, so that a task doesn't hold its rows once for each."""
    m = spark.createDataFrame(feed(3), SCHEMA).localCheckpoint()
    deltas = book.level_deltas(m)
    assert sorts(deltas) == 1
    assert sorts(book.level_volumes(deltas.localCheckpoint())) == 1
    net = {}
    for r in deltas.orderBy("seq").collect():
        level = r.ticker_id, r.day_id, r.side, r.px
        net[(*level, r.seq)] = net.get((*level, r.seq), max([(s, v) for (*k, s), v in net.items() if tuple(k) == level and s < r.seq], default=(0, 0))[1]) + r.delta
    assert {(r.ticker_id, r.day_id, r.side, r.px, r.seq): r.volume for r in book.level_volumes(deltas).collect()} == net


def test_a_long_day_is_numbered_by_many_tasks(spark, long_day):
    """No window has a whole day in one task; large tables get more partitions than the session's."""
    plan = fixture(spark, long_day, "mbo")._jdf.queryExecution().sparkPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("windowspecdefinition(l_orderkey#" in x for x in windows)
    few = spark.range(10)
    assert ranks.parts(few, None) == ranks.parts(few, 4 * ranks.PART_ROWS) == [] and ranks.parts(few, 4 * ranks.PART_ROWS + 1) == [5]


def dealt_by(df, *keys):
    """The exchanges of a plan, before it runs, that deal rows by ``keys`` to a number of tasks of their own."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x and all(f"{k}#" in x for k in keys)]


def test_books_are_dealt_by_their_number_of_rows(spark, monkeypatch):
    """With a number of messages given, more tasks than the session's partitions; results don't change."""
    monkeypatch.setattr(ranks, "PART_ROWS", 50)
    m = spark.createDataFrame(feed(3), SCHEMA).localCheckpoint()
    n = m.count()
    assert n > 4 * 50
    deltas = book.level_deltas(m, n_rows=n)
    assert dealt_by(deltas, "order_id") and not dealt_by(book.level_deltas(m), "order_id")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(deltas) == rows(book.level_deltas(m))
    volumes = book.level_volumes(deltas, n_rows=n)
    assert dealt_by(volumes, "side", "px") and rows(volumes) == rows(book.level_volumes(deltas))
    stab = book.bbo_stab(m, slice_rows=16, n_rows=n)
    assert dealt_by(stab, "slice") and dealt_by(stab, "seq") and rows(stab) == rows(book.bbo_stab(m, slice_rows=16))
    snaps = book.snapshots(m, slice_rows=40, n_rows=n)
    assert dealt_by(snaps, "slice") and dealt_by(snaps, "seq") and rows(snaps) == rows(book.snapshots(m))
    at = m.where("seq % 9 = 0").selectExpr("ticker_id", "day_id", "seq as at")
    depth = book.depth_at(deltas, at, 3, n_rows=n)
    assert dealt_by(depth, "slice") and rows(depth) == rows(book.depth_at(deltas, at, 3))


def test_rows_are_dealt_where_the_session_has_more_partitions_than_cores(spark, monkeypatch):
    """Adaptive execution would join 200 partitions until there are as many as cores, so that a task's rows grow with the table."""
    monkeypatch.setattr(ranks, "PART_ROWS", 50)
    m = spark.createDataFrame(feed(3), SCHEMA).localCheckpoint()
    n = m.count()
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(book.level_volumes(book.level_deltas(m)))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert 4 * 50 < n < 200 * 50 and ranks.parts(m, 4 * 50) == []
        volumes = book.level_volumes(book.level_deltas(m, n_rows=n), n_rows=n)
        assert dealt_by(volumes, "order_id") and dealt_by(volumes, "side", "px") and rows(volumes) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_long_day_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A directory a group, a file a slice at most, and no file that has a whole long day."""
    monkeypatch.setattr(sinks, "SLICE_ROWS", 100)
    rows = spark.range(1000).selectExpr("0 as ticker_id", "cast(id % 10 = 0 as int) as day_id", "id + 1 as seq")
    for n in (1000, None):
        sinks.write_partitioned(rows, str(tmp_path / str(n)), n_rows=n)
        got = spark.read.parquet(str(tmp_path / str(n))).selectExpr("*", "input_file_name() as file", "floor((seq - 1) / 100) as slice")
        assert sorted((r.ticker_id, r.day_id, r.seq) for r in got.collect()) == sorted(map(tuple, rows.collect()))
        files = [len(list((tmp_path / str(n) / "ticker_id=0" / f"day_id={k}").glob("*.parquet"))) for k in (0, 1)]
        assert (n is None or min(files) > 1) and max(files) <= 10 and got.groupBy("day_id", "slice").agg({"file": "count"}).count() == got.select("day_id", "slice", "file").distinct().count()


def test_rows_of_a_day_do_not_meet_for_its_bounds(spark, monkeypatch):
    """No join by group alone is a shuffle; half hours of many rows are cut; results don't change."""
    monkeypatch.setattr(ranks, "PART_ROWS", 50)
    monkeypatch.setattr(asof, "SLICE_ROWS", 20)
    m = spark.createDataFrame(feed(4), SCHEMA).selectExpr("ticker_id", "day_id", "seq", "2000000 + seq * 1000 as ts_us", "event_type", "order_id", "size", "price", "direction").localCheckpoint()
    t = m.where("seq % 7 = 0").selectExpr("ticker_id", "day_id", "seq as tseq", "ts_us", "price as bid_px", "size as bid_sz", "price + 1 as ask_px", "size as ask_sz")
    n, keys = m.count(), ["ticker_id", "day_id"]
    assert asof.width(m, t, keys, "ts_us", asof.HALF_HOUR, 20) == asof.HALF_HOUR // 8 and asof.width(m, t, keys, "ts_us", asof.HALF_HOUR, n) == asof.HALF_HOUR
    rows = lambda df: sorted(map(str, df.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gated = validate.session_gate(m, t, 3000, n_rows=n)
        found = asof.asof(m.select(*keys, "seq", "ts_us"), t, ["tseq"], in_order=True, n_rows=n)
        for df in (gated, found):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert dealt_by(found, "__bucket") and dealt_by(found, "__slice")
        assert rows(gated) == rows(validate.session_gate(m, t, 3000))
        assert rows(found) == rows(asof.asof(m.select(*keys, "seq", "ts_us"), t, ["tseq"], in_order=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_fresh_replay_starts_with_a_piece(tmp_path):
    """Spark asks for the end of the first micro-batch before it says where that starts; it must not be the whole day."""
    from tidemark.sources import fixedrec

    (tmp_path / "mbo_0_0.bin").write_bytes(bytes(36 * 10))
    stream = fixedrec.FixedRecordStream({"kind": "orders", "path": str(tmp_path), "rows_per_file": "4", "fresh": "true"})
    start, ends = {}, []
    for _ in range(3):
        end = stream.latestOffset()
        stream.partitions(start, end)
        start = end
        ends += end.values()
    assert ends == [4, 8, 10]
    with pytest.raises(ValueError):
        fixedrec.FixedRecordStream({"kind": "orders", "path": str(tmp_path), "rows_per_file": "4", "fresh": "true"}).partitions({next(iter(end)): 9}, {next(iter(end)): 4})


def folded_plainly(rows, late, books):
    """(snapshots, late messages) of messages in arrival order, one by one; ``books`` holds orders and the last seq and time."""
    out, behind = [], []
    for seq, ts, event, oid, size, price, direction in rows:
        if seq <= books["seq"]:
            behind.append((seq, ts))
            if late == "drop":
                continue
        books["seq"] = max(books["seq"], seq)
        if not (price >= 10_000_000 or (event == 1 and price == 0)):
            books["orders"][oid] = live.after(books["orders"].get(oid), event, size, price, direction)
            books["ts"] = ts
        books["on"] = books["on"] or ts > 1_000_000
        if books["on"]:
            sides = []
            for sign in (1, -1):
                levels = {}
                for left in books["orders"].values():
                    if left is not None and (left[2] == 1) == (sign == 1):
                        levels[left[1]] = levels.get(left[1], 0) + left[0]
                top = sorted(levels, reverse=sign == 1)[:10]
                sides += [top + [0] * (10 - len(top)), [levels[px] for px in top] + [0] * (10 - len(top))]
            out.append((seq, ts, books["ts"], *sides))
    return out, behind


@pytest.mark.parametrize("late", ["drop", "apply"])
@pytest.mark.parametrize("prices,cells", [(8, 1 << 18), (400, 1 << 18), (400, 64)])
def test_a_micro_batch_folds_as_its_messages_one_by_one(late, prices, cells, monkeypatch):
    """Whatever order of events, sides, levels and late messages, and wherever chunks and blocks are cut."""
    monkeypatch.setattr(live, "ROWS", 37)
    monkeypatch.setattr(live, "CELLS", cells, raising=False)
    monkeypatch.setattr(live, "BUCKET", 4)
    rng = np.random.default_rng(prices)
    fold, batch = processor()
    fold.drop = late == "drop"
    books, seq = {"orders": {}, "seq": -1, "ts": 0, "on": False}, 0
    for _ in range(6):
        rows = []
        for _ in range(150):
            seq = seq + 1 if rng.random() < 0.9 else max(1, seq - int(rng.integers(0, 20)))
            price = int(rng.choice([0, 10_000_000, *(1000 + rng.integers(0, prices, 20))]))
            rows.append((seq, 900_000 + seq * 1000, int(rng.integers(1, 6)), int(rng.integers(0, 60)) * 100_003, int(rng.integers(0, 9)), price, int(rng.choice([1, -1, 0]))))
        out, behind = fold.fold(batch(rows))
        want = folded_plainly(sorted(rows, key=lambda r: r[0]), late, books)
        assert [tuple(map(list, (r[:3], *r[3:]))) for r in out] == [tuple(map(list, (r[:3], *r[3:]))) for r in want[0]] and behind == want[1]
        seq = max(r[0] for r in rows)


class Keyed(Reads):
    """A map state whose keys come as an iterator."""

    def keys(self):
        return iter(list(super().keys()))


def test_orders_far_apart_are_read_in_few_calls():
    """A long day's messages name orders all over its ids; neither calls nor results follow the number of buckets of 4,096 ids."""
    fold, batch = processor()
    fold.orders = Keyed()
    row = lambda seq, oid, event=1, size=5: (seq, 2_000_000 + seq, event, oid, size, 100 + oid % 50, 1 if oid % 2 else -1)
    near = [row(i + 1, i * 1000) for i in range(300)]
    fold.fold(batch(near))
    narrow = len(fold.orders)
    far = [row(301 + i, i * 8111 - 2_000_000) for i in range(5000)]
    fold.fold(batch(far))
    held = len(fold.orders)
    assert 70 < narrow < 256 and held <= 257
    fold.orders.reads = 0
    fold.fold(batch([row(5301 + i, r[3], 2, 2) for i, r in enumerate(near + far)]))
    assert fold.orders.reads <= 257
    width = fold.marks.get()[-1]
    want = {}
    for r in near + far + [row(0, r[3], 2, 2) for r in near + far]:
        want[r[3]] = live.after(want.get(r[3]), r[2], *r[4:])
    assert live.Orders(fold.orders, list(want), width).before == want


def test_late_messages_alone_leave_the_same_book():
    """What isn't asked for isn't handed on; the book is kept all the same."""
    whole, batch = processor()
    alone = processor()[0]
    alone.tells = []
    rows = [(i + 1, 2_000_000 + i, 1 + 3 * (i % 7 == 0), i % 60, 5, 100 + i % 50, 1 if i % 2 else -1) for i in range(400)]
    for part in (rows[:300], rows[280:]):
        want, late = whole.fold(batch(part))
        packed = pd.DataFrame({"row_kind": 0, "rows": [batch(part).to_numpy("int64").tobytes()]})
        got = list(alone.handleInputRows((3, 4), iter([packed]), None))
        assert want and [s for x in got for s in x["seq"].tolist()] == [r[0] for r in late] and all(set(x.columns) == {"ticker_id", "day_id", "kind", "seq", "ts_us"} for x in got)
    assert dict(alone.orders) == dict(whole.orders) and alone.marks.get()[:3] == whole.marks.get()[:3]
    levels = lambda fold: {k: {p: v for p, v in zip(*held)} for k, held in fold.levels.items()}
    assert levels(alone) == levels(whole)


def test_a_streams_state_has_no_more_partitions_than_cores_need(spark, tmp_path):
    """Each partition is opened and committed in every micro-batch, so their number must not follow the session's."""
    rows = feed(5)
    m = spark.createDataFrame(rows, SCHEMA)
    m.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        best = live.live_book(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/run")[1]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40" and best.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len([x for x in (tmp_path / "run/checkpoint/state/0").iterdir() if x.name.isdigit()]) == 16
