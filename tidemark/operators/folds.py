"""Ordered groups in slices, streamed through numpy: one pass, memory bounded by an Arrow batch and the rows a frame holds.

A group is cut into slices, by time or by row.  Each slice gets its own rows and, as a halo, those of its neighbours that the
frames of its rows reach; so a day is spread over as many tasks as it has slices, and the result doesn't depend on where
they are cut.  Rows are dealt by key and slice and sorted; a fold sees each slice's rows in order, batch by batch, and
hands its own rows on with further columns as soon as their frame is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Fold:
    """One group: ``push`` takes its next rows, ``finish`` ends it; both return record batches with the columns added."""

    def push(self, rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        raise NotImplementedError

    def finish(self) -> list[pa.RecordBatch]:
        return []


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows have another key than the row before; the first hasn't."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        column = batch.column(k)
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
        both_null = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
        new[1:] |= ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
    return new


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch cut where a key changes."""
    if batch.num_rows:
        cuts = [0, *np.flatnonzero(starts(batch, keys)).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def halo(df: DataFrame, place: Column, width: int, back: int, ahead: int) -> DataFrame:
    """Every row once for each slice of ``width`` places that it belongs to (``__own``) or that it is near: frames reach ``back`` places back and ``ahead`` on.

    Rows without a place are a slice of their own.
    """
    own = F.floor(place / width)
    near = F.sequence(F.floor((place - ahead) / width), F.floor((place + back) / width))
    each = df.withColumn("__own_slice", own).withColumn("__slice", F.explode(F.coalesce(near, F.array(F.lit(None).cast("long")))))
    return each.withColumn("__own", F.col("__slice").eqNullSafe(F.col("__own_slice"))).drop("__own_slice")


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Fold], added: list[tuple[str, T.DataType]], drop: list[str] = ()) -> DataFrame:
    """The rows of their own slices of ``df``, which ``halo`` has dealt, without ``drop`` and with the columns ``added`` that each slice's fold makes; ``start()`` opens a slice."""
    drop = [*drop, "__slice", "__own"]
    schema = T.StructType([f for f in df.schema.fields if f.name not in drop] + [T.StructField(n, t) for n, t in added])
    dealt = df.repartition(*keys, "__slice").sortWithinPartitions(*keys, "__slice", *order)
    cut = [*keys, "__slice"]

    def own(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("__own"))
            if batch.num_rows:
                yield batch.select(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, fold = None, None
        for batch in batches:
            for part in runs(batch, cut):
                key = tuple(part.column(k)[0].as_py() for k in cut)
                if fold is None or key != here:
                    if fold is not None:
                        yield from own(fold.finish())
                    here, fold = key, start()
                yield from own(fold.push(part))
        if fold is not None:
            yield from own(fold.finish())

    return dealt.mapInArrow(run, schema)


def with_columns(rows: pa.RecordBatch, added: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *[a for _, a in added]], names=[*rows.schema.names, *[n for n, _ in added]])


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Integers, 0 where they are null, and which aren't."""
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), there


class Rolling(Fold):
    """Z-scores of an integer array column over rows i - back .. i + ahead, ends repeated, sums exact.

    A null takes no part in means and deviations, and its own z-score is null.
    """

    def __init__(self, column: str, unit: np.ndarray, back: int, ahead: int) -> None:
        self.column, self.unit, self.back, self.ahead = column, unit, back, ahead
        self.first, self.held, self.there, self.waiting = None, None, None, []

    def push(self, rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        x, there = (a.reshape(rows.num_rows, -1) for a in numbers(rows.column(self.column).flatten()))
        if self.first is None:
            self.first, self.held, self.there = x[0].copy(), np.zeros((0, x.shape[1]), np.int64), np.zeros((0, x.shape[1]), bool)
            x, there = (np.concatenate([np.repeat(a[:1], self.back, axis=0), a]) for a in (x, there))
        self.waiting.append(rows)
        return self.advance(np.where(there, x - self.first, 0), there)

    def finish(self) -> list[pa.RecordBatch]:
        return self.advance(*(np.repeat(a[-1:], self.ahead, axis=0) for a in (self.held, self.there))) if self.ahead else []

    def advance(self, more: np.ndarray, there: np.ndarray) -> list[pa.RecordBatch]:
        held, there, size = np.concatenate([self.held, more]), np.concatenate([self.there, there]), self.back + self.ahead + 1
        ready = len(held) - size + 1
        if ready <= 0:
            self.held, self.there = held, there
            return []
        frame = lambda v: (lambda p: p[size:] - p[:-size])(np.concatenate([np.zeros((1, held.shape[1]), np.int64), np.cumsum(v, axis=0)]))
        s1, s2 = frame(held), frame(held * held)
        n = size if there.all() else np.maximum(frame(there.astype(np.int64)), 1)
        var = (s2 * n - s1 * s1) / (n * n) / (self.unit * self.unit)
        here = slice(self.back, self.back + ready)
        z = (held[here] * n - s1) / (n * self.unit) / np.sqrt(np.maximum(var, 1e-8))
        gone = ~there[here]
        self.held, self.there = held[ready:], there[ready:]
        rows = pa.concat_batches(self.waiting)
        self.waiting = [rows.slice(ready)]
        values = pa.ListArray.from_arrays(pa.array(np.arange(ready + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), mask=gone.ravel() if gone.any() else None))
        return [with_columns(rows.slice(0, ready), [("z", values)])]


class Ahead(Fold):
    """Sum ``__s`` and number ``__c`` of an integer column over the rows with times in [t + lo, t + hi).

    Rows whose value is null aren't counted; rows without a time lie in no frame, and theirs is empty.
    """

    def __init__(self, time: str, column: str, lo: int, hi: int) -> None:
        self.time, self.column, self.lo, self.hi = time, column, lo, hi
        self.t, self.x, self.there, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), []

    def push(self, rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        time = rows.column(self.time)
        if time.null_count:  # a slice of its own
            none = pa.array(np.zeros(rows.num_rows, np.int64))
            return [with_columns(rows, [("__s", none), ("__c", none)])]
        x, there = numbers(rows.column(self.column))
        self.t, self.x, self.there = np.append(self.t, time.to_numpy()), np.append(self.x, x), np.append(self.there, there)
        self.waiting.append(rows)
        return self.advance(int(np.searchsorted(self.t, self.t[-1] - self.hi, side="right")))

    def finish(self) -> list[pa.RecordBatch]:
        return self.advance(len(self.t))

    def advance(self, ready: int) -> list[pa.RecordBatch]:
        if ready <= 0:
            return []
        total, count = np.append(0, np.cumsum(self.x)), np.append(0, np.cumsum(self.there))
        a, b = (np.searchsorted(self.t, self.t[:ready] + d, side="left") for d in (self.lo, self.hi))
        rows = pa.concat_batches(self.waiting)
        self.waiting, self.t, self.x, self.there = [rows.slice(ready)], self.t[ready:], self.x[ready:], self.there[ready:]
        return [with_columns(rows.slice(0, ready), [("__s", pa.array(total[b] - total[a])), ("__c", pa.array(count[b] - count[a]))])]


class Behind(Fold):
    """Of the rows with times in [t - width, t) and a value: their number ``__n``, the step ``__k`` that thins them, and the sum
    ``__total`` of the absolute changes of the integer column between every k-th of them (null under two).

    Rows without a time lie in no frame, and theirs is empty.
    """

    def __init__(self, time: str, column: str, width: int, sample: int) -> None:
        self.time, self.column, self.width, self.sample = time, column, width, sample
        self.t, self.x = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, rows: pa.RecordBatch) -> list[pa.RecordBatch]:
        time = rows.column(self.time)
        if time.null_count:  # a slice of its own
            size = rows.num_rows
            return [with_columns(rows, [("__n", pa.array(np.zeros(size, np.int64))), ("__k", pa.array(np.ones(size, np.int64))), ("__total", pa.nulls(size, pa.int64()))])]
        now, (x, there) = time.to_numpy(), numbers(rows.column(self.column))
        keep = int(np.searchsorted(self.t, now[0] - self.width, side="left"))
        self.t, self.x = np.append(self.t[keep:], now[there]), np.append(self.x[keep:], x[there])
        a, b = np.searchsorted(self.t, now - self.width, side="left"), np.searchsorted(self.t, now, side="left")
        n = b - a
        k = np.maximum(1, np.floor(n * float(self.sample) / self.width).astype(np.int64))
        total = np.zeros(len(now), np.int64)
        for step in np.unique(k[n > k]):  # running sums of the changes over ``step`` rows, one for each start modulo the step
            change = np.zeros(-(-(len(self.x) + 1) // step) * step, np.int64)
            change[step : len(self.x)] = np.abs(self.x[step:] - self.x[:-step])
            run = np.cumsum(change.reshape(-1, step), axis=0).ravel()
            at = np.flatnonzero((k == step) & (n > step))
            last = a[at] + (n[at] - 1) // step * step
            total[at] = run[last] - run[a[at]]
        return [with_columns(rows, [("__n", pa.array(n)), ("__k", pa.array(k)), ("__total", pa.array(total, mask=n <= k))])]
