"""Order-book reconstruction.

Messages are (group, seq, ts_us, event_type, order_id, size, price, direction); sizes are not
negative.  What remains of an order after a message is its size at the last add or modify less
the reductions since, never under 0, and 0 once deleted; so a level's volume is a running sum of
deltas, and a book at any point is a sum over the past.  That lets a trading day be folded in
slices: every slice starts from the sums of the slices before it.  Operators that are told about how many
messages there are, ``n_rows``, deal them to tasks of a bounded number of rows; else the session's partitions count.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.folds import starts
from tidemark.operators.ranks import SLICE_ROWS, dealt, parts, scan
from tidemark.sources.fixtures import GROUP

ADD, CANCEL, DELETE, FILL = 1, 2, 3, 4
MAX_PRICE = 10_000_000
DEPTH = 10


def guarded() -> Column:
    """Messages that leave the book and its snapshot as they were."""
    return (F.col("price") >= MAX_PRICE) | ((F.col("event_type") == ADD) & (F.col("price") == 0))


def generations(messages: DataFrame, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """``generation``: how many messages with a true ``clear`` have come, own row included."""
    return scan(messages, keys, "seq", {"generation": ("sum", F.coalesce(F.col("clear"), F.lit(False)).cast("long"))}, n_rows=n_rows)


def lifecycle(messages: DataFrame, keys: list[str] = GROUP, fill_reduces: bool = True, clear_resets: bool = False, n_rows: int | None = None) -> DataFrame:
    """epoch (adds so far), price0, dir0 (of the last add) and remaining, after every message that counts.

    With ``clear_resets`` a message whose ``clear`` column is true, guarded or not, starts a new ``generation`` of the book, in which no
    order is known.  All runs over one sort by order and seq: what counts since the last add is what counts so far, less what did then.
    """
    if clear_resets:
        messages, keys = generations(messages, keys, n_rows), [*keys, "generation"]
    m = dealt(messages.where(~guarded()), n_rows, *keys, "order_id")
    reducing = [CANCEL, FILL] if fill_reduces else [CANCEL]
    run = W.partitionBy(*keys, "order_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    count = lambda which: F.coalesce(F.sum(which.cast("long")).over(run), F.lit(0).cast("long"))
    add = F.col("event_type") == ADD
    m = m.withColumns({
        "epoch": F.sum(add.cast("long")).over(run), "__deleted": count(F.col("event_type") == DELETE),
        "__reduced": F.coalesce(F.sum(F.when(F.col("event_type").isin(reducing), F.col("size").cast("long"))).over(run), F.lit(0).cast("long")),
    })
    added = F.last(F.when(add, F.struct("size", "price", "direction", "__reduced", "__deleted")), ignorenulls=True).over(run)
    m = m.withColumns({"__add": added, "__first": F.first(F.struct("price", "direction")).over(run)})
    at, known = lambda c: F.col(f"__add.{c}"), F.col("epoch") > 0
    rest = F.greatest(F.lit(0), at("size").cast("long") - (F.col("__reduced") - at("__reduced")))
    left = F.when(~known | (F.col("__deleted") > at("__deleted")), F.lit(0)).otherwise(rest)
    of_add = lambda c: F.when(known, at(c)).otherwise(F.col(f"__first.{c}"))
    m = m.withColumns({"price0": of_add("price"), "dir0": of_add("direction"), "remaining": left.cast("long")})
    return m.drop("__deleted", "__reduced", "__add", "__first")


def level_deltas(messages: DataFrame, keys: list[str] = GROUP, fill_reduces: bool = True, clear_resets: bool = False, n_rows: int | None = None) -> DataFrame:
    """(keys, seq, side, px, delta): none, one or two changes of level volume a message.

    With ``clear_resets`` a clearing message takes off every level what rests there, besides its own change.
    """
    life = lifecycle(messages, keys, fill_reduces, clear_resets, n_rows)
    held = [*keys, "generation"] if clear_resets else keys
    before = W.partitionBy(*held, "order_id").orderBy("seq")
    had = F.coalesce(F.lag("remaining").over(before), F.lit(0).cast("long"))
    life = life.withColumns({"had": had, "px1": F.lag("price0").over(before), "dir1": F.lag("dir0").over(before)})
    change = lambda side, px, delta: F.struct(side.alias("side"), px.alias("px"), delta.alias("delta"))
    out = change(F.col("dir1"), F.col("px1"), -F.col("had"))
    new = change(F.col("dir0"), F.col("price0"), F.col("remaining"))
    less = change(F.col("dir0"), F.col("price0"), F.col("remaining") - F.col("had"))
    both = F.when(F.col("event_type") == ADD, F.array(out, new)).otherwise(F.array(less))
    changes = F.filter(both, lambda x: x.delta != 0)
    deltas = life.select(*keys, "seq", F.inline(changes))
    if not clear_resets:
        return deltas
    resting = life.withColumn("later", F.lead("seq").over(before)).where("later is null and remaining > 0")
    resting = resting.groupBy(*keys, "generation", F.col("dir0").alias("side"), F.col("price0").alias("px")).agg((-F.sum("remaining")).alias("delta"))
    cleared = generations(messages, keys, n_rows).where("clear").select(*keys, "seq", (F.col("generation") - 1).alias("generation"))
    return deltas.unionByName(resting.join(cleared, [*keys, "generation"]).select(*deltas.columns))


def level_volumes(deltas: DataFrame, keys: list[str] = GROUP, n_rows: int | None = None) -> DataFrame:
    """(keys, side, px, seq, volume): the volume of a level after each message that touched it."""
    level = W.partitionBy(*keys, "side", "px").orderBy("seq")
    upto = F.sum("delta").over(level.rangeBetween(W.unboundedPreceding, W.currentRow))  # all changes of a message, of which the last row counts
    rows = dealt(deltas, n_rows, *keys, "side", "px").select(*keys, "side", "px", "seq", upto.alias("volume"), F.lead("seq").over(level).alias("__next"))
    return rows.where("__next is null or __next <> seq").drop("__next")


def bbo_stab(messages: DataFrame, keys: list[str] = GROUP, slice_rows: int = 256, n_rows: int | None = None, **options) -> DataFrame:
    """Best bid and ask after each message by interval stabbing: no Python, for books of few levels.

    A level is live on [seq, next change); intervals are cut at slices, so that a message only meets
    the levels of its own slice.
    """
    levels = level_volumes(level_deltas(messages, keys, n_rows=n_rows, **options), keys, n_rows)
    end = F.lead("seq").over(W.partitionBy(*keys, "side", "px").orderBy("seq"))
    last = messages.groupBy(*keys).agg((F.max("seq") + 1).alias("stop"))
    live = levels.withColumn("end", end).where("volume > 0").join(F.broadcast(last), keys).withColumn("end", F.coalesce("end", "stop"))
    cut = F.sequence(F.floor(F.col("seq") / slice_rows), F.floor((F.col("end") - 1) / slice_rows))
    live = live.select(*keys, "side", "px", F.col("seq").alias("start"), "end", F.explode(cut).alias("slice"))
    at = messages.select(*keys, "seq", F.floor(F.col("seq") / slice_rows).alias("slice"))
    met = dealt(at, n_rows, *keys, "slice").join(dealt(live, n_rows, *keys, "slice"), [*keys, "slice"]).where("seq >= start and seq < end")
    best = met.groupBy(*keys, "slice", "seq").agg(F.max(F.when(F.col("side") == 1, F.col("px"))).alias("bid_px"), F.min(F.when(F.col("side") != 1, F.col("px"))).alias("ask_px"))
    out = dealt(messages.select(*keys, "seq"), n_rows, *keys, "seq").join(dealt(best.drop("slice"), n_rows, *keys, "seq"), [*keys, "seq"], "left")
    return out.select(*keys, "seq", F.coalesce("bid_px", F.lit(0)).alias("bid_px"), F.coalesce("ask_px", F.lit(0)).alias("ask_px"))


class Side:
    """Levels of one side; the ten best, ``px`` and ``sz``, are ``stale`` once a change touches one of them."""

    __slots__ = ("sign", "volume", "prices", "px", "sz", "edge", "stale", "bytes")

    def __init__(self, sign: int) -> None:
        self.sign, self.volume, self.prices = sign, {}, []
        self.px, self.sz = [0] * DEPTH, [0] * DEPTH
        self.edge, self.stale, self.bytes = math.inf, False, None

    def change(self, px: int, delta: int) -> None:
        key = -px * self.sign
        had = self.volume.get(key, 0)
        left = had + delta
        if left > 0:
            if had <= 0:
                insort(self.prices, key)
            self.volume[key] = left
        elif had > 0:
            del self.volume[key]
            del self.prices[bisect_left(self.prices, key)]
        if key <= self.edge:
            self.stale = True

    def at(self, px: int) -> int:
        """The volume of a level, 0 if it isn't there."""
        return self.volume.get(-px * self.sign, 0)

    def rebuild(self) -> None:
        top = self.prices[:DEPTH]
        pad = [0] * (DEPTH - len(top))
        self.px = [-p * self.sign for p in top] + pad
        self.sz = [self.volume[p] for p in top] + pad
        self.edge, self.stale = math.inf if pad else top[-1], False

    def packed(self) -> tuple[bytes, bytes]:
        """The ten best prices and volumes as 64-bit integers."""
        if self.stale or self.bytes is None:
            self.rebuild()
            self.bytes = (array("q", self.px).tobytes(), array("q", self.sz).tobytes())
        return self.bytes


CHANGE = ("side", "px", "delta")


def slice_of(seq: Column, slice_rows: int) -> Column:
    return F.floor((seq - 1) / slice_rows)


def opening(deltas: DataFrame, ends: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """(keys, slice, changes): the levels that a slice opens with, one row each, up to each group's last slice in ``ends`` (keys, last).

    They are the sums of the deltas of the slices before.
    """
    net = deltas.groupBy(*keys, slice_of(F.col("seq"), slice_rows).alias("slice"), "side", "px").agg(F.sum("delta").alias("delta"))
    level = W.partitionBy(*keys, "side", "px").orderBy("slice")
    held = net.select(*keys, "slice", "side", "px", F.sum("delta").over(level.rowsBetween(W.unboundedPreceding, 0)).alias("delta"), F.lead("slice").over(level).alias("next"))
    held = held.where("delta > 0").join(ends, keys).withColumn("until", F.coalesce(F.least("next", "last"), "last")).where("until > slice")
    return held.select(*keys, F.explode(F.sequence(F.col("slice") + 1, F.col("until"))).alias("slice"), F.array(F.struct(*CHANGE)).alias("changes"))


def changes_by_message(deltas: DataFrame, keys: list[str]) -> DataFrame:
    return deltas.groupBy(*keys, "seq").agg(F.collect_list(F.struct(*CHANGE)).alias("changes"))


class Opened:
    """The two sides of the book of a slice, and the changes of an Arrow batch that are put on them."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.here = [*keys, "slice"], None
        self.bid, self.ask = Side(1), Side(-1)

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, bool]]:
        """(row, whether it has changes), once they are on the book; a new slice starts with an empty one."""
        if not batch.num_rows:
            return
        at = lambda i: tuple(batch.column(k)[i].as_py() for k in self.keys)
        fresh = starts(batch, self.keys)
        fresh[0], self.here = at(0) != self.here, at(-1)
        lists = batch.column("changes")
        cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        side, px, delta = (lists.flatten().field(c).to_pylist() for c in CHANGE)
        bid, ask = self.bid, self.ask
        for i, new in enumerate(fresh.tolist()):
            if new:
                bid, ask = self.bid, self.ask = Side(1), Side(-1)
            lo, hi = cuts[i], cuts[i + 1]
            for j in range(lo, hi):
                (bid if side[j] == 1 else ask).change(px[j], delta[j])
            yield i, hi > lo


def snapshots(messages: DataFrame, keys: list[str] = GROUP, slice_rows: int = SLICE_ROWS, emit: str = "all", n_rows: int | None = None, **options) -> DataFrame:
    """(keys, seq, ts_us, snap_us, bid_px, bid_sz, ask_px, ask_sz): the ten-level book after every message.

    ``snap_us`` is the time that the snapshot carries: a guarded message repeats the one before, time
    included (0 before the first).  ``emit="changed"`` leaves out messages that change no volume.
    Each slice of ``slice_rows`` messages is one fold over Arrow batches, opened with the level sums
    of the slices before it.
    """
    at = slice_of(F.col("seq"), slice_rows).alias("slice")
    deltas = level_deltas(messages, keys, n_rows=n_rows, **options)
    none = F.lit(0).cast("long")
    opened = opening(deltas, messages.groupBy(*keys).agg(F.max(at).alias("last")), keys, slice_rows)
    opened = opened.select(*keys, "slice", none.alias("seq"), none.alias("ts_us"), none.alias("snap_us"), "changes")
    timed = scan(messages.select(*keys, "seq", "ts_us", guarded().alias("__guarded")), keys, "seq", {"snap_us": ("last", F.expr("if(__guarded, null, ts_us)"))}, slice_rows, n_rows)
    rows = dealt(timed.select(*keys, at, "seq", "ts_us", F.coalesce("snap_us", none).alias("snap_us")), n_rows, *keys, "seq")
    rows = rows.join(changes_by_message(dealt(deltas, n_rows, *keys, "seq"), keys), [*keys, "seq"], "left")
    folds = rows.select(*opened.columns).unionByName(opened).repartition(*parts(messages, n_rows), *keys, "slice").sortWithinPartitions(*keys, "slice", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq long, ts_us long, snap_us long, bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Opened(keys)
        for batch in batches:
            seqs, keep, books = batch.column("seq").to_pylist(), [], ([], [], [], [])
            for i, changed in book.read(batch):
                if seqs[i] and (emit == "all" or changed):
                    keep.append(i)
                    for out, value in zip(books, (*book.bid.packed(), *book.ask.packed())):
                        out.append(value)
            rows = pa.array(keep, pa.int64())
            cuts = pa.array(np.arange(len(keep) + 1) * DEPTH, pa.int32())
            arrays = [pa.ListArray.from_arrays(cuts, pa.Array.from_buffers(pa.int64(), len(keep) * DEPTH, [None, pa.py_buffer(b"".join(b))])) for b in books]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in [*keys, "seq", "ts_us", "snap_us"]], *arrays], names=[*keys, "seq", "ts_us", "snap_us", "bid_px", "bid_sz", "ask_px", "ask_sz"])

    return folds.mapInArrow(fold, schema)


def depth_at(deltas: DataFrame, instants: DataFrame, k: int, keys: list[str] = GROUP, slice_rows: int = SLICE_ROWS, n_rows: int | None = None) -> DataFrame:
    """(keys, at, side, level, px, volume): the k best levels of each side after the messages ``instants`` (keys, at).

    Instants are rows of the fold over slices: each is answered from the ordered levels of its slice as they are then, so
    the cost is that of the deltas, of the levels that slices open with and of k levels an instant.
    """
    none, asks = F.lit(0).cast("long"), F.col("at").alias("seq")
    last = instants.groupBy(*keys).agg(F.max(slice_of(F.col("at"), slice_rows)).alias("last"))
    opened = opening(deltas, last, keys, slice_rows).select(*keys, "slice", none.alias("seq"), F.lit(0).alias("kind"), "changes")
    changed = changes_by_message(dealt(deltas, n_rows, *keys, "seq"), keys).select(*keys, slice_of(F.col("seq"), slice_rows).alias("slice"), "seq", F.lit(0).alias("kind"), "changes")
    asked = instants.select(*keys, slice_of(F.col("at"), slice_rows).alias("slice"), asks, F.lit(1).alias("kind"), F.lit(None).cast("array<struct<side: int, px: bigint, delta: bigint>>").alias("changes"))
    folds = asked.unionByName(changed.unionByName(opened)).repartition(*parts(deltas, n_rows), *keys, "slice").sortWithinPartitions(*keys, "slice", "seq", "kind")
    kinds = {f.name: f.dataType.simpleString() for f in instants.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", at long, side int, level long, px long, volume long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Opened(keys)
        for batch in batches:
            kind, keep, found = batch.column("kind").to_pylist(), [], []
            for i, _ in book.read(batch):
                if kind[i]:
                    levels = [(side.sign, n, -p * side.sign, side.volume[p]) for side in (book.bid, book.ask) for n, p in enumerate(side.prices[:k], 1)]
                    keep += [i] * len(levels)
                    found += levels
            rows, columns = pa.array(keep, pa.int64()), list(zip(*found)) or [[], [], [], []]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in [*keys, "seq"]], *made], names=[*keys, "at", "side", "level", "px", "volume"])

    return folds.mapInArrow(fold, schema)


def bbo(snaps: DataFrame, keys: list[str] = GROUP, time: str = "ts_us") -> DataFrame:
    """Best bid and ask of snapshots, at the message's time or, with ``time="snap_us"``, at the time that the snapshot carries."""
    best = lambda c: F.col(c)[0]
    return snaps.select(*keys, "seq", F.col(time).alias("ts_us"), best("bid_px").alias("bid_px"), best("bid_sz").alias("bid_sz"), best("ask_px").alias("ask_px"), best("ask_sz").alias("ask_sz"))


def exploded(snaps: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """(keys, seq, side, level, px, vol), one row for each level that is there."""
    both = snaps.select(*keys, "seq", F.size("bid_px").alias("__bids"), F.concat("bid_px", "ask_px").alias("px"), F.concat("bid_sz", "ask_sz").alias("vol"))
    rows = both.select(*keys, "seq", "__bids", F.posexplode(F.arrays_zip("px", "vol")).alias("__at", "__level")).where("__level.px > 0")
    bid = F.col("__at") < F.col("__bids")
    level = F.when(bid, F.col("__at")).otherwise(F.col("__at") - F.col("__bids")) + 1
    return rows.select(*keys, "seq", F.when(bid, 1).otherwise(-1).alias("side"), level.cast("long").alias("level"), "__level.px", "__level.vol")
