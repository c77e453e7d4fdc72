"""The live book: messages in, snapshots out, with the same results as the batch fold; and its check against live quotes.

State per group is keyed: what remains of the orders in buckets of ``ORDERS`` ids or, where their ids lie far apart, of four times as many and so on, the volumes of the levels in
buckets of ``BUCKET`` prices, and one row of marks.  A micro-batch of a group is sorted by seq and folded as columns; it reads the buckets of the orders that its messages name and writes those that
they change, each in one call, and reads the best levels' buckets down to the tenth level, so there is never more than one read and one write
a message.  Snapshots are handed on in chunks of ``ROWS``, so that none but a chunk's are held.  What Python takes and gives is packed: messages of an Arrow batch
and a group come as one row of 64-bit integers, and levels go as columns of integers, of which Spark makes arrays, so that none is converted on its own.  Across micro-batches arrival order counts.  A message whose seq is not after the last one folded is late: with ``late="drop"`` it
is left out, with ``late="apply"`` it is folded where it arrives; either way it comes out as a row of its own, of kind ``late``.

With ``hold`` messages are put in order before they are folded.  Seqs have no gaps, so one that doesn't follow the last is early: it waits in the state until those
between have come, or until a message ``hold`` further on has, which gives them up.  No more than ``hold`` messages wait, none without a gap,
and a gap's messages that come after all are late.

The check is told quotes as they come, by a second stream.  Quotes that no message has reached yet wait in chunks; a message moves on
to the last quote at or before its time, or the time of any message before it, and what it has passed is dropped.  A message is settled once a
later quote has come, and until then counts as the quotes so far have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import book, validate
from tidemark.sources.fixtures import GROUP

LEVELS = "bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>"
OUT = f"ticker_id int, day_id int, kind string, seq long, ts_us long, snap_us long, {LEVELS}"
COUNTS = "ticker_id int, day_id int, updates long, matched long, failed long"
RATES = "ticker_id int, day_id int, starts_us long, n long"
FIELDS = ("seq", "ts_us", "event_type", "order_id", "size", "price", "direction")
TOLD = ("seq", "ts_us", "bid_px", "ask_px")
PACKED = "ticker_id int, day_id int, row_kind int, rows binary"
SIDES = ("bid_px", "bid_sz", "ask_px", "ask_sz")
FLAT = ["seq", "ts_us", "snap_us", *[f"{c}_{i}" for c in SIDES for i in range(book.DEPTH)]]
TIMED, BEST = FLAT[:2], [f"{c}_0" for c in SIDES]
#: How a stream keeps its state: a micro-batch writes what it changes, not the files of a whole store, and old versions go.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
BUCKET, CHUNK, ORDERS, ROWS = 64, 1024, 4096, 8192
SPREAD, CELLS = 256, 1 << 18  # buckets of orders that a micro-batch reads, and levels times messages that are followed at once, at most
MESSAGE, QUOTE = 0, 1


def after(held: tuple | None, event: int, size: int, price: int, direction: int) -> tuple | None:
    """What remains of an order, (size, price, direction), once a message has come; None if nothing does."""
    if event == book.ADD:
        held = (size, price, direction)
    elif held is not None and event in (book.CANCEL, book.FILL, book.DELETE):
        held = (0 if event == book.DELETE else held[0] - size, *held[1:])
    return held if held is not None and held[0] > 0 else None


def flat_out(tells: list[str]) -> str:
    """The schema of what ``LiveBook`` hands on."""
    return ", ".join(["ticker_id int", "day_id int", "kind string", *[f"{c} long" for c in tells or TIMED]])


def packed(rows: DataFrame, fields: tuple[str, ...], row_kind: int) -> DataFrame:
    """(keys, row_kind, rows): those of a group and an Arrow batch as one row of 64-bit integers.

    A null size counts as 0, as in the batch fold; nulls elsewhere are errors.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in GROUP])
            order = np.lexsort(keys.T[::-1])
            keys, values = keys[order], np.column_stack([batch.column(c).to_numpy() for c in fields])[order]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            held = [values[lo:hi].tobytes() for lo, hi in zip(first, np.append(first[1:], len(values)))]
            ints = [*keys[first].T, np.full(len(first), row_kind)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in ints], pa.array(held, pa.binary())], names=[*GROUP, "row_kind", "rows"])

    whole = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) if c == "size" else F.col(c).cast("long").alias(c) for c in fields]
    return rows.select(*[F.col(k).cast("int").alias(k) for k in GROUP], *whole).mapInArrow(pack, PACKED)


def unpacked(rows: Iterable[bytes], fields: tuple[str, ...]) -> pd.DataFrame:
    """Rows that ``packed`` has made one, as columns."""
    return pd.DataFrame(np.frombuffer(b"".join(rows), np.int64).reshape(-1, len(fields)), columns=list(fields))


class Ladder:
    """One side of the book, best level first, of which only the buckets that are needed are read from the state."""

    def __init__(self, sign: int, state, live: list[int]) -> None:
        self.state, self.sign = state, sign
        self.keys, self.volumes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # keys are prices, negated on the bid side
        self.waiting = sorted(live, key=self.best)
        self.read, self.touched = set(), set()

    def best(self, bucket: int) -> int:
        """Where the best price that a bucket can have stands in the order of the side."""
        return -self.sign * (bucket * BUCKET + (BUCKET - 1 if self.sign == 1 else 0))

    def load(self, buckets: list[int]) -> None:
        self.read.update(buckets)
        there = set(buckets).intersection(self.waiting)
        if there:
            self.waiting = [b for b in self.waiting if b not in there]
            found = [np.array(list(self.state.getValue((self.sign, b))), np.int64) for b in sorted(there)]
            self.put(*np.concatenate(found, axis=1) * np.array([[-self.sign], [1]]))

    def put(self, keys: np.ndarray, deltas: np.ndarray) -> None:
        """Add to the levels with these keys, each given once; those that nothing is left of go."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        self.volumes[at[there]] += deltas[there]
        keys, volumes = np.concatenate([self.keys, keys[~there]]), np.concatenate([self.volumes, deltas[~there]])
        keys, volumes = keys[volumes > 0], volumes[volumes > 0]
        order = np.argsort(keys, kind="stable")
        self.keys, self.volumes = keys[order], volumes[order]

    def touch(self, px: np.ndarray) -> None:
        """Read the buckets of these prices, which are to be written."""
        buckets = np.unique(px // BUCKET).tolist()
        self.touched.update(buckets)
        self.load([b for b in buckets if b not in self.read])

    def change(self, px: np.ndarray, delta: np.ndarray) -> None:
        """Add ``delta[i]`` to the level ``px[i]``."""
        self.touch(px)
        changed, column = np.unique(-px * self.sign, return_inverse=True)
        total = np.zeros(len(changed), np.int64)
        np.add.at(total, column, delta)
        self.put(changed, total)

    def after(self, at: np.ndarray, px: np.ndarray, delta: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(prices, volumes) of the ten best levels after each of n messages, ten rows of n; message ``at[i]``, in order, adds ``delta[i]`` to the level ``px[i]``.

        A level that isn't changed and has ten as good that aren't changed either is never among the ten best, so only few are followed from message to message.
        """
        self.touch(px)
        changed, column = np.unique(-px * self.sign, return_inverse=True)
        while True:
            rest = self.keys[~np.isin(self.keys, changed, assume_unique=True)]
            edge = rest[book.DEPTH - 1] if len(rest) >= book.DEPTH else None
            if not self.waiting or (edge is not None and edge <= self.best(self.waiting[0])):
                break
            self.load(self.waiting[:1])
        seen = np.union1d(changed, rest[: book.DEPTH])
        if edge is not None:
            seen = seen[seen <= edge]
        near = changed[column] <= (np.inf if edge is None else edge)
        rows, row = np.unique(at[near], return_inverse=True)
        if len(rows) > 1 and (len(rows) + 1) * len(seen) > CELLS:
            cut = rows[len(rows) // 2]
            k = np.searchsorted(at, cut)
            parts = [self.after(at[:k], px[:k], delta[:k], int(cut)), self.after(at[k:] - cut, px[k:], delta[k:], n - int(cut))]
            return tuple(np.concatenate(x, axis=1) for x in zip(*parts))
        volumes = np.zeros((len(rows) + 1, len(seen)), np.int64)
        where = np.searchsorted(self.keys, seen)
        held = where < len(self.keys)
        held[held] = self.keys[where[held]] == seen[held]
        volumes[0, held] = self.volumes[where[held]]
        np.add.at(volumes.reshape(-1), (row + 1) * len(seen) + np.searchsorted(seen, changed[column[near]]), delta[near])
        np.cumsum(volumes, axis=0, out=volumes)
        there = volumes > 0
        place = np.cumsum(there, axis=1, dtype=np.int32)
        r, c = np.nonzero(there & (place <= book.DEPTH))
        best, sizes = np.zeros((2, book.DEPTH, len(rows) + 1), np.int64)
        level = place[r, c] - 1
        best[level, r], sizes[level, r] = -seen[c] * self.sign, volumes[r, c]
        self.change(px, delta)
        upto = np.searchsorted(rows, np.arange(n), side="right")
        return best[:, upto], sizes[:, upto]

    def save(self) -> list[int]:
        """Write the buckets that were touched; the buckets that have levels now."""
        prices, live = -self.keys * self.sign, list(self.waiting)
        order = np.argsort(prices, kind="stable")
        prices, volumes = prices[order], self.volumes[order]
        for bucket in self.read:
            lo, hi = np.searchsorted(prices, [bucket * BUCKET, (bucket + 1) * BUCKET]).tolist()
            if lo < hi:
                live.append(bucket)
            if bucket in self.touched:
                if lo < hi:
                    self.state.updateValue((self.sign, bucket), (prices[lo:hi].tolist(), volumes[lo:hi].tolist()))
                elif self.state.containsKey((self.sign, bucket)):
                    self.state.removeKey((self.sign, bucket))
        return live


class Orders:
    """What remains of the orders that a micro-batch names; their buckets of ``width`` ids are read and written whole, as packed rows (id, size, price, direction) by id.

    Where the ids lie in more than ``SPREAD`` buckets, buckets become wider, so that few calls read them.
    """

    def __init__(self, state, ids: list[int] | np.ndarray, width: int = ORDERS) -> None:
        self.state, self.named, self.width = state, np.unique(np.array(ids, np.int64)), width
        while len(buckets := np.unique(self.named // self.width)) > SPREAD:
            self.width *= 4
        if self.width != width:
            self.widen(width)
        self.there, held = set(), []
        for bucket in buckets.tolist():
            if (value := state.getValue((bucket,))) is not None:
                self.there.add(bucket)
                held.append(bytes(value[0]))
        self.rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, 4)
        self.left = np.zeros((len(self.named), 3), np.int64)  # size, price, direction; 0 where there is no order
        found = self.rows[np.isin(self.rows[:, 0], self.named, assume_unique=True)]
        self.left[np.searchsorted(self.named, found[:, 0])] = found[:, 1:]

    def widen(self, width: int) -> None:
        """Put the buckets of ``width`` ids together to wider ones, one of which is held at a time."""
        wide: dict[int, list[int]] = {}
        for (bucket,) in list(self.state.keys()):
            wide.setdefault(bucket * width // self.width, []).append(bucket)
        for bucket, parts in sorted(wide.items(), key=lambda x: max(x[0], ~x[0])):  # from 0 outwards, so that no wide bucket takes the number of a narrow one that is yet to come
            held = b"".join(bytes(self.state.getValue((part,))[0]) for part in sorted(parts))
            for part in parts:
                self.state.removeKey((part,))
            self.state.updateValue((bucket,), (held,))

    @property
    def before(self) -> dict[int, tuple | None]:
        return {oid: tuple(left) if left[0] > 0 else None for oid, left in zip(self.named.tolist(), self.left.tolist())}

    def save(self, left: np.ndarray) -> None:
        """Write the buckets of which an order has changed; ``left`` as ``self.left``."""
        change = (left != self.left).any(axis=1)
        if not change.any():
            return
        changed = self.named[change]
        new = np.column_stack([changed, left[change]])
        rows = np.concatenate([self.rows[~np.isin(self.rows[:, 0], changed, assume_unique=True)], new[new[:, 1] > 0]])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        buckets = np.unique(changed // self.width)
        cuts = np.searchsorted(rows[:, 0] // self.width, [buckets, buckets + 1]).T.tolist()
        for bucket, (lo, hi) in zip(buckets.tolist(), cuts):
            if lo < hi:
                self.state.updateValue((bucket,), (rows[lo:hi].tobytes(),))
            elif bucket in self.there:
                self.state.removeKey((bucket,))


def lives(rows: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what each message finds of its order, what it leaves, what remains of each order at last) of messages ``FIELDS`` in order: size, price and direction, 0 where there is nothing, as ``after`` has it.

    Messages are sorted by order, each order headed by what it had before; an order's size is that of its last add less what was taken off since, until that comes to nothing.
    """
    ids, n = len(orders.named), len(rows)
    own = np.searchsorted(orders.named, rows[:, 3])
    order = np.argsort(own, kind="stable")
    own = own[order]
    head = np.searchsorted(own, np.arange(ids)) + np.arange(ids)
    place = np.arange(n) + own + 1
    size, price, direction, taken = np.zeros((4, n + ids), np.int64)
    add, dead = np.zeros((2, n + ids), bool)
    event = rows[order, 2]
    add[head], add[place] = True, event == book.ADD
    for column, i in ((size, 4), (price, 5), (direction, 6)):
        column[head], column[place] = orders.left[:, i - 4], rows[order, i]
    taken[place] = np.where((event == book.CANCEL) | (event == book.FILL), rows[order, 4], 0)
    dead[place] = event == book.DELETE
    since, total = np.maximum.accumulate(np.where(add, np.arange(n + ids), 0)), np.cumsum(taken)
    rest = size[since] - (total - total[since])
    dead |= rest <= 0
    deaths = np.cumsum(dead)
    alive = deaths - deaths[since] + dead[since] == 0
    left = np.column_stack([rest, price[since], direction[since]]) * alive[:, None]
    found, leaves = np.zeros((2, n, 3), np.int64)
    found[order], leaves[order] = left[place - 1], left[place]
    return found, leaves, left[np.append(head[1:], n + ids) - 1] if ids else orders.left


class LiveBook(StatefulProcessor):
    """Folds the micro-batches of a group; emits from the first message with a time over 1 s on.

    Of snapshots it hands on the columns ``tells``; where that is none the book is kept all the same, and late messages are handed on alone.
    """

    def __init__(self, drop: bool, hold: int = 0, first_seq: int = 1, tells: list[str] = FLAT) -> None:
        self.drop, self.hold, self.first_seq, self.tells = drop, hold, first_seq, tells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getListState("early", ", ".join(f"{c} long" for c in FIELDS))
        self.orders = handle.getMapState("orders", "bucket long", "held binary")
        self.levels = handle.getMapState("levels", "direction int, bucket long", "price array<long>, volume array<long>")
        self.marks = handle.getValueState("marks", "snap_us long, last_seq long, on boolean, bids array<long>, asks array<long>, waiting int, width long")

    def in_turn(self, seqs: list[int], last_seq: int) -> int:
        """How many messages are to be folded, of which the seqs are in order; the others wait."""
        top = max(seqs[-1], last_seq) if seqs else last_seq
        for i, seq in enumerate(seqs):
            if seq > last_seq + 1 and seq + self.hold > top:
                return i
            last_seq = max(last_seq, seq)
        return len(seqs)

    def fold(self, batch: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
        """(snapshots, late messages) of a micro-batch of messages, as ``folded`` has them."""
        out, late = [], []
        for more in self.folded(batch):
            out += more[0]
            late += more[1]
        return out, late

    def folded(self, batch: pd.DataFrame) -> Iterator[tuple[list[tuple], list[tuple]]]:
        """Chunks of (snapshots, late messages) of a micro-batch of messages: (seq, ts_us, snap_us, bid_px, bid_sz, ask_px, ask_sz) and (seq, ts_us)."""
        for books, late in self.booked(batch[list(FIELDS)].to_numpy(np.int64)):
            sides = books[3:].reshape(len(SIDES), book.DEPTH, -1).transpose(0, 2, 1).tolist()
            yield [*zip(*books[:3].tolist(), *sides)], [*map(tuple, late.T.tolist())]

    def booked(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (snapshots, late messages) of a micro-batch of messages, rows of ``FIELDS``: columns of ``FLAT``, and of seq and ts_us."""
        snap_us, last_seq, on, bids, asks, waiting, width = self.marks.get() or (0, self.first_seq - 1 if self.hold else -1, False, [], [], 0, ORDERS)
        if waiting:
            rows = np.concatenate([np.array([*map(tuple, self.early.get())], np.int64).reshape(-1, len(FIELDS)), rows])
        rows, early = rows[np.argsort(rows[:, 0], kind="stable")], []
        if self.hold:
            n = self.in_turn(rows[:, 0].tolist(), last_seq)
            rows, early = rows[:n], [*map(tuple, rows[n:].tolist())]
        if waiting and not early:
            self.early.clear()
        elif early:
            self.early.put(early)
        behind = rows[:, 0] <= np.maximum(np.append(last_seq, rows[:-1, 0])[: len(rows)], last_seq)
        late = rows[behind, :2].T
        for lo in range(0, late.shape[1], ROWS):
            yield np.zeros((len(FLAT), 0), np.int64), late[:, lo : lo + ROWS]
        last_seq = max(last_seq, int(rows[-1, 0])) if len(rows) else last_seq
        if self.drop:
            rows = rows[~behind]
        price, event, times = rows[:, 5], rows[:, 2], rows[:, 1]
        counts = np.flatnonzero(~((price >= book.MAX_PRICE) | ((event == book.ADD) & (price == 0))))
        orders = Orders(self.orders, rows[counts, 3], width)
        found, leaves, last = lives(rows[counts], orders)
        change = (found != leaves).any(axis=1)
        moves = [np.column_stack([counts, side[:, 2] == 1, side[:, 1], sign * side[:, 0]])[change & (side[:, 0] > 0)] for side, sign in ((found, -1), (leaves, 1))]
        moves = np.concatenate(moves)
        moves = moves[np.argsort(moves[:, 0], kind="stable")]
        counted = np.zeros(len(rows), np.int64)
        counted[counts] = counts + 1
        counted = np.maximum.accumulate(counted)
        snaps = np.where(counted > 0, times[counted - 1], snap_us) if len(rows) else times
        told = np.logical_or.accumulate(np.append(on, times > validate.SECOND))[1:]
        bid, ask = Ladder(1, self.levels, bids), Ladder(-1, self.levels, asks)
        if not self.tells:
            for ladder, is_bid in ((bid, 1), (ask, 0)):
                ladder.change(*moves[moves[:, 1] == is_bid][:, 2:].T)
        for lo in range(0, len(rows) if self.tells else 0, ROWS):
            hi = min(lo + ROWS, len(rows))
            part = moves[slice(*np.searchsorted(moves[:, 0], [lo, hi]))]
            sides = [ladder.after(*(part[part[:, 1] == is_bid][:, [0, 2, 3]] - [lo, 0, 0]).T, hi - lo) for ladder, is_bid in ((bid, 1), (ask, 0))]
            books = np.vstack([rows[lo:hi, 0], times[lo:hi], snaps[lo:hi], *sides[0], *sides[1]])
            yield books if told[lo] else books[:, told[lo:hi]], np.zeros((2, 0), np.int64)
        orders.save(last)
        if len(rows):
            snap_us, on = int(snaps[-1]), bool(told[-1])
        self.marks.update((snap_us, last_seq, on, bid.save(), ask.save(), len(early), orders.width))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for books, late in self.booked(unpacked((r for part in rows for r in part["rows"]), FIELDS).to_numpy()):
            for kind, found in (("book", books), ("late", late)):
                if found.shape[1]:
                    found = np.pad(found, ((0, len(FLAT) - len(found)), (0, 0)))
                    columns = {c: pd.arrays.ArrowExtensionArray(pa.array(found[FLAT.index(c)])) for c in self.tells or TIMED}
                    yield pd.DataFrame({"ticker_id": key[0], "day_id": key[1], "kind": kind, **columns})

    def close(self) -> None:
        pass


class Quotes:
    """The quotes of a group that wait, in chunks of the state, and the one that the messages have come to."""

    def __init__(self, state, head: int, at: int, tail: int, here: tuple | None) -> None:
        self.state, self.head, self.at, self.tail, self.here = state, head, at, tail, here
        self.chunk = None

    def append(self, quotes: list[tuple]) -> None:
        for first in range(0, len(quotes), CHUNK):
            self.state.updateValue((self.tail,), tuple(list(c) for c in zip(*quotes[first : first + CHUNK])))
            self.tail += 1

    def next(self) -> tuple | None:
        """The first quote that waits."""
        if self.head == self.tail:
            return None
        if self.chunk is None:
            self.chunk = self.state.getValue((self.head,))
        return tuple(c[self.at] for c in self.chunk)

    def advance(self, t: int) -> None:
        """Go on to the last quote at or before t; chunks that are passed are removed."""
        while (quote := self.next()) is not None and quote[0] <= t:
            self.here = quote
            self.at += 1
            if self.at == len(self.chunk[0]):
                self.state.removeKey((self.head,))
                self.head, self.at, self.chunk = self.head + 1, 0, None


class LiveCheck(LiveBook):
    """The live book, whose best prices are counted against the quotes of a second stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.chunks = handle.getMapState("quotes", "chunk long", "ts array<long>, bid array<long>, ask array<long>")
        self.pending = handle.getListState("pending", "t long, bid long, ask long")
        self.place = handle.getValueState("place", "head long, at int, tail long, ts long, bid long, ask long, latest long, t long, updates long, matched long, failed long, open_matched long, open_failed long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = {MESSAGE: [], QUOTE: []}
        for part in rows:
            for row_kind, r in zip(part["row_kind"], part["rows"]):
                come[row_kind].append(r)
        told = unpacked(come[QUOTE], TOLD).sort_values("seq", kind="stable")
        sent = unpacked(come[MESSAGE], FIELDS)
        head, at, tail, here_ts, bid, ask, latest, t, updates, matched, failed, open_matched, open_failed = self.place.get() or (0, 0, 0, None, None, None, None, -1, 0, 0, 0, 0, 0)
        quotes = Quotes(self.chunks, head, at, tail, None if here_ts is None else (here_ts, bid, ask))
        books = []
        for chunk, _ in self.booked(sent.to_numpy()) if len(sent) else []:
            if chunk.shape[1]:
                times = np.maximum.accumulate(np.maximum(chunk[1], t))  # times never move back
                t = int(times[-1])
                books += zip(times.tolist(), *chunk[[FLAT.index("bid_px_0"), FLAT.index("ask_px_0")]].tolist())
        if len(told):
            stamps = []
            for ts in told["ts_us"].tolist():
                latest = ts if latest is None else max(latest, ts)
                stamps.append(latest)
            quotes.append(list(zip(stamps, told["bid_px"].tolist(), told["ask_px"].tolist())))
            books, open_matched, open_failed = [*map(tuple, self.pending.get()), *books], 0, 0
            self.pending.clear()
        waiting = []
        for ts, *best in books:
            quotes.advance(ts)
            later = quotes.next()
            met = quotes.here or later
            hit = met is not None and tuple(best) == met[1:]
            if later is not None:
                matched, failed = matched + hit, failed + (not hit)
                continue
            waiting.append((ts, *best))
            if met is not None:
                open_matched, open_failed = open_matched + hit, open_failed + (not hit)
        if waiting:
            self.pending.appendList(waiting)
        here = quotes.here or (None, None, None)
        self.place.update((quotes.head, quotes.at, quotes.tail, *here, latest, t, updates + 1, matched, failed, open_matched, open_failed))
        if latest is not None:
            yield pd.DataFrame([(*key, updates + 1, matched + open_matched, failed + open_failed)], columns=["ticker_id", "day_id", "updates", "matched", "failed"])


def live_flat(messages: DataFrame, late: str = "drop", hold: int = 0, tells: list[str] = FLAT) -> DataFrame:
    """``live_snapshots`` with a column for each price and size, of which ``tells`` are there; those of late messages are 0."""
    if late not in ("drop", "apply"):
        raise ValueError(late)
    return packed(messages, FIELDS, MESSAGE).groupBy(*GROUP).transformWithStateInPandas(LiveBook(late == "drop", hold, tells=tells), flat_out(tells), "append", "none")


def with_levels(rows: DataFrame) -> DataFrame:
    """Rows of ``live_flat`` with their levels as arrays."""
    of_book = lambda c: F.when(F.col("kind") == "book", c)
    levels = [of_book(F.array(*[F.col(f"{c}_{i}") for i in range(book.DEPTH)])).alias(c) for c in SIDES]
    return rows.select(*GROUP, "kind", "seq", "ts_us", of_book(F.col("snap_us")).alias("snap_us"), *levels)


def live_snapshots(messages: DataFrame, late: str = "drop", hold: int = 0) -> DataFrame:
    """Streaming snapshots (kind ``book``) and late messages (kind ``late``) of streaming messages, by group.

    Keyed state needs the RocksDB state store, which ``run_to_end`` sets.
    """
    return with_levels(live_flat(messages, late, hold))


def live_counts(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(keys, updates, matched, failed): how many best prices so far are those of the quotes, after each micro-batch of a group; the greatest ``updates`` counts."""
    both = packed(messages, FIELDS, MESSAGE).unionByName(packed(quotes, TOLD, QUOTE))
    return both.groupBy(*GROUP).transformWithStateInPandas(LiveCheck(True), COUNTS, "append", "none")


def recorded(snaps: DataFrame) -> DataFrame:
    """What the recorder keeps: snapshots whose own time is at least 1 s."""
    return snaps.where(F.col("snap_us") >= validate.SECOND)


def state_parts(spark: SparkSession) -> int:
    """Into how many partitions a stream's state is cut: the session's, but no more than four a core.

    Each is opened, committed and given a Python worker in every micro-batch, whether it has a group or not.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def run_to_end(stream: DataFrame, folder: str, each, mode: str = "append", arrivals: Iterable[Callable[[], None]] = ()) -> None:
    """Drain a stream through ``each(batch, id)`` until nothing new is there; its state is kept in RocksDB, that of other streams where it was.

    Each of ``arrivals`` brings more input, once what was there is drained.
    """
    conf, given = stream.sparkSession.conf, {**STORE, "spark.sql.shuffle.partitions": str(state_parts(stream.sparkSession))}
    former = {name: conf.get(name, None) for name in given}
    for name, value in given.items():
        conf.set(name, value)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(each).start()
    finally:
        for name, value in former.items():
            conf.unset(name) if value is None else conf.set(name, value)
    try:
        query.processAllAvailable()
        for bring in arrivals:
            bring()
            query.processAllAvailable()
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the micro-batches have written; nothing where there was none."""
    try:
        return spark.read.parquet(path).drop("batch")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def book_rows(stream: DataFrame, folder: str, late: str = "drop", hold: int = 0, arrivals: Iterable[Callable[[], None]] = (), tells: list[str] = FLAT) -> DataFrame:
    """Rows of ``live_flat`` of a stream of messages, written under ``folder`` by one stateful query.

    A micro-batch is written once and not held.  A stream that is run again with its folder goes on from its checkpoint.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/book/batch={batch_id}")

    run_to_end(live_flat(stream, late, hold, tells), folder, keep, arrivals=arrivals)
    return written(stream.sparkSession, f"{folder}/book", flat_out(tells))


def best_of(rows: DataFrame) -> DataFrame:
    """The best prices and sizes of ``book_rows``."""
    return rows.where("kind = 'book'").select(*GROUP, *TIMED, *[F.col(b).alias(c) for b, c in zip(BEST, SIDES)])


def late_of(rows: DataFrame) -> DataFrame:
    """The late messages of ``book_rows``."""
    return rows.where("kind = 'late'").select(*GROUP, *TIMED)


def live_book(stream: DataFrame, folder: str, late: str = "drop", hold: int = 0, arrivals: Iterable[Callable[[], None]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, best prices, late messages) of a stream of messages, written under ``folder`` by one stateful query: the recorder and the monitor.

    All three are columns or rows of one table, ``book_rows``, and levels become arrays where they are read.
    """
    rows = book_rows(stream, folder, late, hold, arrivals)
    return with_levels(rows.where("kind = 'book'")).drop("kind"), best_of(rows), late_of(rows)


def late_counts(late: DataFrame) -> DataFrame:
    """(keys, late): how many messages of each group were late."""
    return late.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("late"))


def live_accuracy(messages: DataFrame, quotes: DataFrame, folder: str) -> DataFrame:
    """(keys, matched, failed, accuracy) of a stream of messages and a stream of quotes, both of which keep their place."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    run_to_end(live_counts(messages, quotes), folder, keep)
    counts = written(messages.sparkSession, f"{folder}/counts", COUNTS)
    last = counts.groupBy(*GROUP).agg(F.max(F.struct("updates", "matched", "failed")).alias("c")).select(*GROUP, "c.matched", "c.failed")
    out = last.where(F.col("matched") + F.col("failed") > 0)
    return out.withColumn("accuracy", validate.accuracy(F.col("matched"), F.col("matched") + F.col("failed")))


def rate_stream(rows: DataFrame, minutes: int = 30, lateness: str | None = None) -> DataFrame:
    """(keys, starts_us, n): streaming counts of rows by window of event time, aligned to the clock.

    Without ``lateness`` every row counts, however late, and the state is one number a window.  With it windows are
    forgotten once they lie that far behind the latest time, and rows that come for them after that don't count.
    Rows without a time have a window of their own, whose start is null; with ``lateness`` they don't count.
    """
    timed = rows.withColumn("at", F.timestamp_micros("ts_us"))
    if lateness is None:
        width = minutes * 60_000_000
        return timed.groupBy(*GROUP, (F.col("ts_us") - F.pmod("ts_us", F.lit(width))).alias("starts_us")).agg(F.count(F.lit(1)).alias("n"))
    counted = timed.withWatermark("at", lateness).groupBy(*GROUP, F.window("at", f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*GROUP, F.unix_micros("window.start").alias("starts_us"), "n")


def live_rates(rows: DataFrame, folder: str, minutes: int = 30, lateness: str | None = None) -> DataFrame:
    """(keys, starts_us, n, rate): rows and rows a second by window of a stream, drained under ``folder``; a window without rows is left out.

    A micro-batch writes the windows that it changes; the greatest count of a window is its last.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rates/batch={batch_id}")

    run_to_end(rate_stream(rows, minutes, lateness), folder, keep, "update")
    counts = written(rows.sparkSession, f"{folder}/rates", RATES).groupBy(*GROUP, "starts_us").agg(F.max("n").alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / (minutes * 60.0), 9))
