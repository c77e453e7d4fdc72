"""Fixed-size binary records as a Spark data source, to read, to write and to follow.

``format("fixedrec")`` has little-endian records of the kinds ``orders`` (36 bytes), ``truth`` and
``bbo`` (32) and ``snapshots`` (248).  Paths are URIs of any store that ``pyarrow.fs`` opens (a bare path is a local one);
a file is cut at record bounds into partitions of about ``partition_bytes``, each of which is opened at its offset and
read as one numpy array a chunk.  A last, incomplete record is an error when files are read, and waits for its rest when they are followed.

Columns are ``file``, ``seq`` (the record's place in its file, from 1), ``ts_us`` and those of the kind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

QUOTE = [("time", "<f8"), ("bid_px", "<u8"), ("bid_sz", "<i4"), ("ask_px", "<u8"), ("ask_sz", "<i4")]
LAYOUTS = {
    "orders": np.dtype([("time", "<f8"), ("event_type", "<i4"), ("order_id", "<u8"), ("size", "<i4"), ("price", "<u8"), ("direction", "<i4")]),
    "truth": np.dtype(QUOTE),
    "bbo": np.dtype(QUOTE),
    "snapshots": np.dtype([("time", "<f8"), ("bid_px", "<u8", 10), ("bid_sz", "<i4", 10), ("ask_px", "<u8", 10), ("ask_sz", "<i4", 10)]),
}
CHUNK = 8192


def _schema(kind: str) -> str:
    cols = ["file string", "seq long", "ts_us long"]
    for name in LAYOUTS[kind].names[1:]:
        cols.append(f"{name} array<long>" if LAYOUTS[kind][name].shape else f"{name} long")
    return ", ".join(cols)


def _batch(records: np.ndarray, file: str, first: int) -> pa.RecordBatch:
    n = len(records)
    columns = [pa.array([file] * n, pa.string()), pa.array(np.arange(first + 1, first + n + 1)), pa.array(np.round(records["time"] * 1e6).astype(np.int64))]
    names = ["file", "seq", "ts_us"]
    for name in records.dtype.names[1:]:
        values = records[name].astype(np.int64)
        if values.ndim == 2:
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), pa.array(values.ravel())))
        else:
            columns.append(pa.array(values))
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names=names)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it.  Hadoop's names of object stores are read as theirs; a bare path is a local one."""
    for hadoop, own in (("s3a://", "s3://"), ("s3n://", "s3://"), ("file:/", "file:///")):
        if uri.startswith(hadoop):
            uri = own + uri[len(hadoop) :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_files(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the ``.bin`` files of a folder, by name; files whose names start with a dot or underscore are not there yet."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and (x is info or x.base_name.endswith(".bin") and x.base_name[0] not in "._"))


class Part(InputPartition):
    """Records ``first`` .. ``first + count`` of a file."""

    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


class Ranges:
    """Reading ranges of records; shared by the batch and the stream reader."""

    def __init__(self, options: dict) -> None:
        self.kind, self.uri = options["kind"], options["path"]
        self.step = max(1, int(options.get("partition_bytes", 64 << 20)) // LAYOUTS[self.kind].itemsize)

    def cut(self, path: str, first: int, end: int) -> list[Part]:
        return [Part(path, at, min(self.step, end - at)) for at in range(first, end, self.step)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        dtype, store = LAYOUTS[self.kind], opened(self.uri)[0]
        with store.open_input_file(partition.path) as file:
            for at in range(partition.first, partition.first + partition.count, CHUNK):
                n = min(CHUNK, partition.first + partition.count - at)
                yield _batch(np.frombuffer(file.read_at(n * dtype.itemsize, at * dtype.itemsize), dtype), partition.path.rpartition("/")[2], at)


class FixedRecordReader(Ranges, DataSourceReader):
    def partitions(self) -> list[Part]:
        size, found = LAYOUTS[self.kind].itemsize, []
        for path, length in record_files(self.uri):
            if length % size:
                raise ValueError(f"{path}: not a multiple of {size} bytes")
            found += self.cut(path, 0, length // size)
        return found


class FixedRecordStream(Ranges, DataSourceStreamReader):
    """Follows the record files of a folder, which may grow and be joined by others.

    The offset is the number of records read of each file, so a restart goes on where the checkpoint ends, and a micro-batch that failed
    reads the same ranges again.  With ``rows_per_file`` a micro-batch reads so many records of each file at most, which replays
    stored files piece by piece; the first micro-batch of a query reads all that is there, since Spark doesn't say then where it starts,
    unless ``fresh`` tells that it has no checkpoint yet.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.most = int(options["rows_per_file"]) if options.get("rows_per_file") else None
        self.at: dict | None = {} if str(options.get("fresh", "")).lower() == "true" else None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        size = LAYOUTS[self.kind].itemsize
        there = {path: length // size for path, length in record_files(self.uri)}
        if self.most is not None and self.at is not None:
            there = {path: min(n, self.at.get(path, 0) + self.most) for path, n in there.items()}
        return there

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if any(n < start.get(path, 0) for path, n in end.items()):
            raise ValueError("the stream isn't fresh: its checkpoint is further on")
        self.at = end
        return [part for path, n in sorted(end.items()) for part in self.cut(path, start.get(path, 0), n)]

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Written(WriterCommitMessage):
    """The files that a task has written aside, as (temporary path, name)."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class FixedRecordWriter(DataSourceArrowWriter):
    """One file of records for each run of equal ``keys``; a task writes aside, and the driver moves files into place when all tasks have ended.

    An attempt that fails removes what it wrote; a job that fails removes what its tasks wrote, and leaves the folder's files as they were.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.kind, self.uri, self.name, self.overwrite = options["kind"], options["path"], options.get("name", "{}.bin"), overwrite
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from tidemark.operators.folds import runs

        store, path = opened(self.uri)
        folder, dtype = f"{path}/{self.aside}", LAYOUTS[self.kind]
        store.create_dir(folder, recursive=True)
        here, out, files = None, None, []
        try:
            for batch in iterator:
                for part in runs(batch, self.keys):
                    key = tuple(part.column(k)[0].as_py() for k in self.keys)
                    if out is None or key != here:
                        if out is not None:
                            out.close()
                        here, name = key, self.name.format(*key)
                        files.append((f"{folder}/{uuid.uuid4().hex}", name))
                        out = store.open_output_stream(files[-1][0])
                    out.write(_records(part, dtype, list(dtype.names[1:])).tobytes())
        except BaseException:
            for at, _ in files:
                if store.get_file_info(at).type == fs.FileType.File:
                    store.delete_file(at)
            raise
        finally:
            if out is not None and not out.closed:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = opened(self.uri)
        files = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote the same file: deal rows by the keys first")
        if self.overwrite:
            for old, _ in record_files(self.uri):
                store.delete_file(old)
        for at, name in files:
            store.move(at, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = opened(self.uri)
        folder = f"{path}/{self.aside}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def schema(self) -> str:
        return _schema(self.options["kind"])

    def reader(self, schema) -> FixedRecordReader:
        return FixedRecordReader(self.options)

    def streamReader(self, schema) -> FixedRecordStream:
        return FixedRecordStream(self.options)

    def writer(self, schema, overwrite: bool) -> FixedRecordWriter:
        return FixedRecordWriter(self.options, overwrite)


def read_fixed(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    spark.dataSource.register(FixedRecords)
    return spark.read.format("fixedrec").option("kind", kind).options(**options).load(path)


def follow_fixed(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """A stream of the records of a folder's files, in the order of each file."""
    spark.dataSource.register(FixedRecords)
    return spark.readStream.format("fixedrec").option("kind", kind).options(**options).load(path)


def _records(batch: pa.RecordBatch, dtype: np.dtype, names: list[str]) -> np.ndarray:
    out = np.zeros(batch.num_rows, dtype)
    out["time"] = batch.column("ts_us").to_numpy() / 1e6
    for name in names:
        column = batch.column(name)
        out[name] = column.flatten().to_numpy().reshape(batch.num_rows, -1) if dtype[name].shape else column.to_numpy()
    return out


def encoded(rows: DataFrame, kind: str) -> DataFrame:
    """(seq, record binary) from rows with the columns of the layout and ts_us."""
    dtype = LAYOUTS[kind]
    names = list(dtype.names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, size = _records(batch, dtype, names).tobytes(), dtype.itemsize
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], names=["seq", "record"])

    return rows.select("seq", "ts_us", *names).mapInArrow(run, "seq long, record binary")


def decoded(records: DataFrame, kind: str, keep: list[str] = ()) -> DataFrame:
    """The columns of the layout from (keep.., seq, record)."""
    dtype = LAYOUTS[kind]
    schema = ", ".join([f"{c} {records.schema[c].dataType.simpleString()}" for c in keep] + [_schema(kind).removeprefix("file string, ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _batch(np.frombuffer(b"".join(batch.column("record").to_pylist()), dtype), "", 0)
            kept = [batch.column(c) for c in [*keep, "seq"]]
            yield pa.RecordBatch.from_arrays([*kept, *got.columns[2:]], names=[*keep, "seq", *got.schema.names[2:]])

    return records.select(*keep, "seq", "record").mapInArrow(run, schema)


def write_records(rows: DataFrame, path: str, kind: str, keys: list[str], name: str = "{}.bin") -> None:
    """One file of records a group of ``keys``, in seq order; ``name`` takes the keys.

    Rows are dealt by group and streamed into the group's file.
    """
    rows.sparkSession.dataSource.register(FixedRecords)
    dealt = rows.select(*keys, "seq", "ts_us", *LAYOUTS[kind].names[1:]).repartition(*keys).sortWithinPartitions(*keys, "seq")
    dealt.write.format("fixedrec").option("kind", kind).option("keys", ",".join(keys)).option("name", name).mode("append").save(path)


def group_of(file):
    """(ticker, date, kind) from a file name like ``nvda_20260105_orders.bin``."""
    part = lambda i: F.regexp_extract(file, r"([^/_]+)_([^/_]+)_([^/_.]+)\.bin$", i)
    return F.upper(part(1)).alias("ticker"), F.to_date(part(2), "yyyyMMdd").alias("date"), part(3).alias("kind")
