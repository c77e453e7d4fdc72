"""The distributed book against a sequential fold, its invariants and its edges."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import book, validate
from tidemark.sources import fixedrec
from tidemark.sources.fixtures import keyed
from tidemark.streaming import live

SCHEMA = "ticker_id int, day_id int, seq long, ts_us long, event_type int, order_id long, size int, price long, direction int"


def feed(seed, groups=2, n=120):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        for seq in range(1, n + 1):
            price = draw.choice([0, 10_000_000, *range(95, 106)]) if draw.random() < 0.2 else draw.randrange(90, 111)
            rows.append((g, 0, seq, 2_000_000 + seq * 1000 - draw.choice([0, 0, 1500]), draw.choice([1, 1, 1, 2, 2, 3, 4, 7]), draw.randrange(12), draw.choice([0, 5, 10, 20, 60]), price, draw.choice([1, -1])))
    return rows


def twin(rows, arrival=False):
    """(group, seq) -> (snap time, bid levels, ask levels), one message after the other, by seq or as they arrive."""
    out, books = {}, {}
    for g, d, seq, ts, event, oid, size, price, side in sorted(rows, key=lambda r: r[:2] if arrival else r[:3]):
        orders, last = books.setdefault((g, d), ({}, [0]))
        if not (price >= 10_000_000 or (event == 1 and price == 0)):
            if event == 1:
                orders[oid] = [size, price, side]
            elif oid in orders and event in (2, 3, 4):
                orders[oid][0] -= orders[oid][0] if event == 3 else min(size, orders[oid][0])
                if orders[oid][0] <= 0:
                    del orders[oid]
            last[0] = ts
        levels = {1: {}, -1: {}}
        for s, p, way in orders.values():
            if s > 0:
                levels[way][p] = levels[way].get(p, 0) + s
        top = {w: sorted(levels[w].items(), reverse=w == 1)[:10] for w in (1, -1)}
        out[(g, d, seq)] = (last[0], top[1], top[-1])
    return out


def as_twin(df):
    live_levels = lambda px, sz: [(p, s) for p, s in zip(px, sz) if p]
    return {(r.ticker_id, r.day_id, r.seq): (r.snap_us, live_levels(r.bid_px, r.bid_sz), live_levels(r.ask_px, r.ask_sz)) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("slice_rows", [7, 1000])
def test_snapshots_equal_a_sequential_fold(spark, seed, slice_rows):
    rows = feed(seed)
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    assert as_twin(book.snapshots(spark.createDataFrame(shuffled, SCHEMA), slice_rows=slice_rows)) == twin(rows)


def test_arrow_batches_may_split_a_slice(spark):
    rows = feed(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert as_twin(book.snapshots(spark.createDataFrame(rows, SCHEMA), slice_rows=50)) == twin(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stab_and_depth_agree_with_the_fold(spark):
    rows = feed(3)
    m = spark.createDataFrame(rows, SCHEMA)
    want = twin(rows)
    best = {(r.ticker_id, r.day_id, r.seq): (r.bid_px, r.ask_px) for r in book.bbo_stab(m, slice_rows=16).collect()}
    assert best == {k: (v[1][0][0] if v[1] else 0, v[2][0][0] if v[2] else 0) for k, v in want.items()}
    at = m.where("seq % 40 = 0").select("ticker_id", "day_id", F.col("seq").alias("at"))
    got = {}
    for r in book.depth_at(book.level_deltas(m), at, 3).collect():
        got.setdefault((r.ticker_id, r.day_id, r["at"], r.side), []).append((r.level, r.px, r.volume))
    for (g, d, seq), (_, bids, asks) in want.items():
        if seq % 40 == 0:
            for side, levels in ((1, bids), (-1, asks)):
                assert sorted(got.get((g, d, seq, side), [])) == [(i + 1, p, v) for i, (p, v) in enumerate(levels[:3])]


def test_invariants(spark):
    m = spark.createDataFrame(feed(4, 1, 300), SCHEMA)
    assert book.level_volumes(book.level_deltas(m)).where("volume < 0").isEmpty()
    for r in book.snapshots(m).collect():
        bids, asks = [p for p in r.bid_px if p], [p for p in r.ask_px if p]
        assert bids == sorted(set(bids), reverse=True) and asks == sorted(set(asks))
        assert r.bid_px[len(bids):] == [0] * (10 - len(bids)) and len(r.ask_px) == 10


def test_hand_made_edges(spark):
    rows = [
        (0, 0, 1, 5, 1, 1, 9, 10_000_000, 1),  # guarded first: an empty book with time 0
        (0, 0, 2, 6, 3, 7, 1, 100, 1),  # unknown id
        (0, 0, 3, 7, 1, 1, 10, 100, 1),
        (0, 0, 4, 8, 2, 1, 25, 100, 1),  # more than remains
        (0, 0, 5, 9, 2, 1, 5, 100, 1),  # after exhaustion
        (0, 0, 6, 10, 1, 1, 4, 101, -1),  # added again on the other side
        (0, 0, 7, 11, 1, 1, 6, 99, 1),  # moves price and side
        (0, 0, 8, 12, 9, 1, 6, 50, 1),  # unknown event
    ]
    got = as_twin(book.snapshots(spark.createDataFrame(rows, SCHEMA)))
    assert got == twin(rows)
    assert got[(0, 0, 1)] == (0, [], []) and got[(0, 0, 8)] == (12, [(99, 6)], [])


def test_options(spark):
    rows = [(0, 0, 1, 1, 1, 1, 10, 100, 1, False), (0, 0, 2, 2, 4, 1, 4, 100, 1, False), (0, 0, 3, 3, 3, 2, 0, 100, 1, True), (0, 0, 4, 4, 2, 1, 1, 100, 1, False)]
    m = spark.createDataFrame(rows, SCHEMA + ", clear boolean")
    left = lambda **o: [r.remaining for r in book.lifecycle(m.where("order_id = 1"), **o).orderBy("seq").collect()]
    assert left() == [10, 6, 5] and left(fill_reduces=False) == [10, 10, 9]
    assert [r.remaining for r in book.lifecycle(m, clear_resets=True).where("order_id = 1").orderBy("seq").collect()] == [10, 6, 0]
    assert {r.seq for r in book.snapshots(m, emit="changed").collect()} == {1, 2, 4}


@pytest.mark.parametrize("slice_rows", [2, 1000])
def test_a_clear_empties_the_book(spark, slice_rows):
    rows = [
        (0, 0, 1, 1, 1, 1, 10, 100, 1, False), (0, 0, 2, 2, 1, 2, 5, 110, -1, False), (0, 0, 3, 3, 1, 3, 7, 100, 1, None), (0, 0, 4, 4, 2, 3, 2, 100, 1, False),
        (0, 0, 5, 5, 3, 9, 0, 20_000_000, 1, True),  # guarded, but it clears
        (0, 0, 6, 6, 2, 1, 1, 100, 1, False), (0, 0, 7, 7, 1, 4, 3, 99, 1, False), (0, 0, 8, 8, 1, 4, 4, 98, 1, True), (1, 0, 1, 1, 1, 1, 10, 100, 1, False),
    ]
    m = spark.createDataFrame(rows, SCHEMA + ", clear boolean")
    got = as_twin(book.snapshots(m, slice_rows=slice_rows, clear_resets=True))
    assert got[(0, 0, 4)][1:] == ([(100, 15)], [(110, 5)]) and got[(0, 0, 5)][1:] == ([], []) and got[(0, 0, 6)][1:] == ([], [])
    assert got[(0, 0, 7)][1:] == ([(99, 3)], []) and got[(0, 0, 8)][1:] == ([(98, 4)], []) and got[(1, 0, 1)][1:] == ([(100, 10)], [])
    assert {(r.seq, r.bid_px, r.ask_px) for r in book.bbo_stab(m.where("ticker_id = 0"), clear_resets=True).collect()} == {(s, b[0][0] if b else 0, a[0][0] if a else 0) for (t, _, s), (_, b, a) in got.items() if t == 0}


def records(rows, folder, first=0, upto=None):
    """Append messages ``first`` .. ``upto`` of each group to its file of records."""
    kind = fixedrec.LAYOUTS["orders"]
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append((r[3] / 1e6, *r[4:]))
    folder.mkdir(exist_ok=True)
    for (ticker, day), held in groups.items():
        with open(folder / f"mbo_{ticker}_{day}.bin", "ab") as out:
            out.write(np.array(held[first:upto], kind).tobytes())


def numbered(rows):
    """Rows of each group from seq 1 on, as record files number them."""
    at, out = {}, []
    for r in rows:
        at[r[:2]] = at.get(r[:2], 0) + 1
        out.append((*r[:2], at[r[:2]], *r[3:]))
    return out


@pytest.mark.parametrize("rows_per_file", [None, 37])
def test_live_equals_batch(spark, rows_per_file, tmp_path):
    rows = numbered(feed(6))
    records(rows, tmp_path / "in")
    stream = keyed(fixedrec.follow_fixed(spark, f"file://{tmp_path}/in", "orders", **({"rows_per_file": rows_per_file} if rows_per_file else {}), partition_bytes=36 * 20))
    snaps, best, late = live.live_book(stream, str(tmp_path))
    assert late.count() == 0 and as_twin(snaps) == twin(rows) and best.count() == len(rows)


def test_live_book_goes_on_after_a_restart(spark, tmp_path):
    rows = numbered(feed(7))
    for first, upto in ((0, 50), (50, 51), (51, None)):
        records(rows, tmp_path / "in", first, upto)
        if upto is None:
            with open(next((tmp_path / "in").iterdir()), "ab") as out:
                out.write(b"half a record")  # waits for its rest
        snaps = live.live_book(keyed(fixedrec.follow_fixed(spark, str(tmp_path / "in"), "orders", rows_per_file=20)), str(tmp_path))[0]
    assert snaps.count() == len(rows) and as_twin(snaps) == twin(rows)


def test_live_rates(spark, tmp_path):
    """Equal to plain counts over a restart, late rows and rows without a time included; with lateness old windows are closed."""
    rows = [(1, 1, t) for t in (0, 5, 1_800_000_000, 9_000_000_000)] + [(2, 1, 7), (2, 1, None)], [(1, 1, 6), (1, 1, 9_000_000_001), (2, 1, None)]
    whole, closed = str(tmp_path / "whole"), str(tmp_path / "closed")
    for part in rows:
        spark.createDataFrame(part, "ticker_id int, day_id int, ts_us long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ticker_id int, day_id int, ts_us long").parquet(f"{tmp_path}/in")
        got, late = live.live_rates(stream, whole), live.live_rates(stream, closed, lateness="10 minutes")
    want = Counter((k, d, None if t is None else t - t % 1_800_000_000) for k, d, t in rows[0] + rows[1])
    assert {(r.ticker_id, r.day_id, r.starts_us): r.n for r in got.collect()} == dict(want)
    assert all(r.rate == round(r.n / 1800, 9) for r in got.collect())
    assert {(r.ticker_id, r.starts_us): r.n for r in late.collect()} == {(1, 0): 2, (1, 1_800_000_000): 1, (1, 9_000_000_000): 2, (2, 0): 1}
    none = spark.createDataFrame([], "ticker_id int, day_id int, ts_us long")
    none.write.parquet(f"{tmp_path}/none")
    assert live.live_rates(spark.readStream.schema(none.schema).parquet(f"{tmp_path}/none"), str(tmp_path / "empty")).count() == 0


def test_late_messages_fold_where_they_arrive(spark, tmp_path):
    rows, folder = feed(9), str(tmp_path)
    late = [r for r in rows if r[2] % 4 == 0]
    first = [r for r in rows if r[2] % 4 != 0]
    tops = {}
    for r in first:
        tops[r[:2]] = max(tops.get(r[:2], 0), r[2])
    behind = sorted(r[:4] for r in late if r[2] < tops[r[:2]])
    found = {}
    for part in (first, late):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        for how in ("apply", "drop"):
            found[how] = live.live_book(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/{how}", how)
    assert as_twin(found["apply"][0]) == twin(first + late, arrival=True)
    assert as_twin(found["drop"][0]) == twin(first + [r for r in late if r[2] > tops[r[:2]]], arrival=True)
    for how in found:
        assert sorted(tuple(r) for r in found[how][2].collect()) == behind and sum(r.late for r in live.late_counts(found[how][2]).collect()) == len(behind)


class Held(list):
    """A list state."""

    def get(self):
        return iter(list(self))

    def put(self, rows):
        self[:] = rows

    def appendList(self, rows):
        self.extend(rows)


class Value:
    held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def processor(**options):
    import pandas as pd

    fold = live.LiveBook(True, **options)
    fold.orders, fold.levels, fold.marks, fold.early = Reads(), Reads(), Value(), Held()
    return fold, lambda rows: pd.DataFrame(rows, columns=list(live.FIELDS))


@pytest.mark.parametrize("seed", range(5))
def test_messages_are_put_in_order(seed):
    """Rows that come up to eight places late, in pieces of any size, fold as if they had come in order."""
    rows, draw = numbered(feed(seed, 1, 300)), random.Random(seed)
    come = sorted(rows, key=lambda r: r[2] + draw.random() * 8)
    fold, batch = processor(hold=12)
    got, most = [], 0
    while come:
        n = draw.choice([1, 2, 7, 40])
        out, late = fold.fold(batch([r[2:] for r in come[:n]]))
        come, most = come[n:], max(most, len(fold.early))
        got += out
        assert late == []
    assert most <= 12 and len(fold.early) == 0 and [r[0] for r in got] == list(range(1, 301))
    want = twin(rows)
    for seq, _, snap, bid, bid_sz, ask, ask_sz in got:
        assert (snap, [x for x in zip(bid, bid_sz) if x[0]], [x for x in zip(ask, ask_sz) if x[0]]) == (want[(0, 0, seq)][0], want[(0, 0, seq)][1][:10], want[(0, 0, seq)][2][:10])


def test_a_gap_is_given_up_after_hold():
    fold, batch = processor(hold=5)
    row = lambda seq: (seq, 2_000_000 + seq, 1, seq, 5, 100, 1)
    assert [r[0] for r in fold.fold(batch([row(1), row(3), row(4)]))[0]] == [1] and len(fold.early) == 2
    assert [r[0] for r in fold.fold(batch([row(8)]))[0]] == [3, 4] and len(fold.early) == 1
    out, late = fold.fold(batch([row(2), row(5), row(6), row(7)]))
    assert [r[0] for r in out] == [5, 6, 7, 8] and late == [(2, 2_000_002)] and len(fold.early) == 0


class Reads(dict):
    """A map state that counts what is read."""

    reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]


def test_a_micro_batch_reads_the_buckets_it_needs():
    fold, batch = processor()
    many = [(i + 1, 2_000_000 + i, 1, i, 5, 100_000 - i if i % 2 else 200_000 + i, 1 if i % 2 else -1) for i in range(20_000)]
    fold.fold(batch(many))
    buckets = len(fold.levels)
    assert buckets > 300
    fold.levels.reads = fold.orders.reads = 0
    out, _ = fold.fold(batch([(20_001, 9_000_000, 1, 50_001, 7, 99_998, 1), (20_002, 9_000_001, 3, 3, 0, 0, 1), (20_003, 9_000_002, 2, 19_999, 1, 0, 1)]))
    assert fold.levels.reads <= 6 and fold.orders.reads == 3
    assert out[0][3][:3] == [99_999, 99_998, 99_997] and out[0][4][:2] == [5, 7] and out[1][3][:3] == [99_999, 99_998, 99_995] and out[2][5][0] == 200_000


def checked(messages, quotes):
    """(matched, failed) of (ts, bid, ask): each against the last quote at or before its time, or any before it; the first quote if there is none."""
    hits, t, stamps, top = 0, -1, [], -1
    for ts, *_ in quotes:
        top = max(top, ts)
        stamps.append(top)
    for ts, *best in messages:
        t = max(t, ts)
        met = [q for stamp, q in zip(stamps, quotes) if stamp <= t]
        hits += list((met[-1] if met else quotes[0])[1:]) == best
    return hits, len(messages) - hits


@pytest.mark.parametrize("first", ["quotes", "messages", "both"])
def test_live_check_keeps_its_place(spark, first, tmp_path):
    """Whatever comes first, in pieces of any size, and after a restart."""
    rows = numbered(feed(8))
    books, quotes, rng = twin_bbo(rows), {}, np.random.default_rng(0)
    for g, held in books.items():
        quotes[g] = [(ts + int(rng.integers(-2, 3)), bid if rng.random() < 0.7 else bid + 1, ask) for ts, bid, ask in held if rng.random() < 0.4 or ts == held[0][0]]
    def told():
        (tmp_path / "truth").mkdir(exist_ok=True)
        for (ticker, day), held in quotes.items():
            (tmp_path / "truth" / f"truth_{ticker}_{day}.bin").write_bytes(np.array([(ts / 1e6, bid, 1, ask, 1) for ts, bid, ask in held], fixedrec.LAYOUTS["truth"]).tobytes())
    (tmp_path / "in").mkdir()
    (tmp_path / "truth").mkdir()
    for turn in range(2):
        if first == "both" or (turn == 0) == (first == "quotes"):
            told()
        if first == "both" or (turn == 0) == (first == "messages"):
            if not any((tmp_path / "in").iterdir()):
                records(rows, tmp_path / "in")
        sent = keyed(fixedrec.follow_fixed(spark, str(tmp_path / "in"), "orders", rows_per_file=70))
        said = keyed(fixedrec.follow_fixed(spark, str(tmp_path / "truth"), "truth", rows_per_file=30))
        got = {(r.ticker_id, r.day_id): (r.matched, r.failed) for r in live.live_accuracy(sent, said, str(tmp_path)).collect()}
    assert got == {g: checked(books[g], quotes[g]) for g in books}


def twin_bbo(rows):
    """(ts, bid, ask) after each message, by group."""
    out, books = {}, twin(rows)
    for r in rows:
        _, bids, asks = books[r[:3]]
        out.setdefault(r[:2], []).append((r[3], bids[0][0] if bids else 0, asks[0][0] if asks else 0))
    return out


@pytest.mark.parametrize("held,message,left", [(None, (2, 5, 9, 1), None), (None, (1, 0, 9, 1), None), ((7, 9, 1), (4, 5, 3, -1), (2, 9, 1)), ((7, 9, 1), (2, 8, 9, 1), None), ((7, 9, 1), (3, 0, 9, 1), None), ((7, 9, 1), (1, 4, 8, -1), (4, 8, -1)), ((7, 9, 1), (9, 1, 9, 1), (7, 9, 1))])
def test_what_remains_of_an_order(held, message, left):
    assert live.after(held, *message) == left


def test_gates(spark):
    truth = spark.createDataFrame([(0, 0, 1, 100_000_000, 1, 1, 2, 1), (0, 0, 2, 200_000_000, 1, 1, 2, 1)], "ticker_id int, day_id int, tseq long, ts_us long, bid_px long, bid_sz int, ask_px long, ask_sz int")
    times = [500_000, 39_999_999, 40_000_000, 260_000_000, 260_000_001, 150_000_000]
    m = spark.createDataFrame([(0, 0, i, t, 1, i, 1, 5, 1) for i, t in enumerate(times)], SCHEMA)
    assert [r.seq for r in validate.session_gate(m, truth).orderBy("seq").collect()] == [2, 3]
