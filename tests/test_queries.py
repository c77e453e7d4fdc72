"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry
from tidemark.sources import fixedrec

DATA = "/root/testdata/sf0.001"
SLOW = set()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(registry.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def sample(kind, n=1000):
    dtype = fixedrec.LAYOUTS[kind]
    rows = np.zeros(n, dtype)
    rows["time"] = np.arange(n) + 0.25
    column = "bid_px" if kind != "orders" else "price"
    rows[column] = np.arange(n * 10).reshape(n, 10) if dtype[column].shape else np.arange(n)
    return rows


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
@pytest.mark.parametrize("kind", fixedrec.LAYOUTS)
def test_fixed_records_of_any_path(spark, tmp_path, kind, prefix):
    rows = sample(kind)
    path = tmp_path / f"nvda_20260105_{kind}.bin"
    rows.tofile(path)
    got = fixedrec.read_fixed(spark, f"{prefix}{path}", kind, partition_bytes=rows.itemsize * 300)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 1000
    last = got.orderBy("seq").collect()[-1]
    assert last.seq == 1000 and last.ts_us == 999_250_000
    ticker, date, what = fixedrec.group_of(got["file"])
    assert got.select(ticker, what).distinct().collect() == [("NVDA", kind)]
    (tmp_path / "_aside.bin").write_bytes(b"x")
    (tmp_path / ".hidden.bin").write_bytes(b"x")
    assert fixedrec.read_fixed(spark, f"{prefix}{tmp_path}", kind).count() == 1000


def test_incomplete_and_missing_records(spark, tmp_path):
    (tmp_path / "bad.bin").write_bytes(b"x" * 37)
    with pytest.raises(Exception, match="multiple of 36"):
        fixedrec.read_fixed(spark, str(tmp_path / "bad.bin"), "orders").count()
    with pytest.raises(Exception, match="nowhere"):
        fixedrec.read_fixed(spark, str(tmp_path / "nowhere"), "orders").count()


def order_rows(spark, groups, n):
    return spark.range(groups * n).selectExpr("cast(id % {0} as int) as g".format(groups), "id div {0} + 1 as seq".format(groups), "id * 1000 as ts_us", "1L as event_type", "id as order_id", "5L as size", "100L as price", "-1L as direction")


def test_written_records_come_back(spark, tmp_path):
    rows, path = order_rows(spark, 3, 500), f"file:{tmp_path}/out"
    fixedrec.write_records(rows, path, "orders", ["g"], "g{}.bin")
    got = fixedrec.read_fixed(spark, path, "orders")
    want = rows.selectExpr("concat('g', g, '.bin') as file", "seq", "ts_us", "event_type", "order_id", "size", "price", "direction")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    fixedrec.write_records(rows.where("g = 1 and seq <= 7"), path, "orders", ["g"], "g{}.bin")  # replaces that file alone
    assert fixedrec.read_fixed(spark, path, "orders").count() == 1007
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["g0.bin", "g1.bin", "g2.bin"]


def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path):
    rows, path = order_rows(spark, 2, 50), str(tmp_path / "out")
    fixedrec.write_records(rows, path, "orders", ["g"], "g{}.bin")
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    broken = rows.withColumn("price", F.when((F.col("g") == 1) & (F.col("seq") == 50), F.raise_error(F.lit("broken")).cast("long")).otherwise(F.lit(7).cast("long")))
    with pytest.raises(Exception, match="broken"):
        fixedrec.write_records(broken, path, "orders", ["g"], "g{}.bin")
    with pytest.raises(Exception, match="same file"):
        fixedrec.write_records(rows, path, "orders", ["g"], "one.bin")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before


def test_an_attempt_that_fails_is_written_again(spark, tmp_path):
    """What a lost attempt wrote isn't moved into place."""
    writer = fixedrec.FixedRecordWriter({"kind": "orders", "path": str(tmp_path), "keys": "g", "name": "g{}.bin"}, False)
    batches = order_rows(spark, 1, 40).toArrow().to_batches()

    def dying():
        yield batches[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    lost = writer.write(iter(batches))  # its answer never reaches the driver
    again = writer.write(iter(batches))
    assert len(lost.files) == len(again.files) == 1
    writer.commit([again])
    assert [p.name for p in tmp_path.iterdir()] == ["g0.bin"] and (tmp_path / "g0.bin").stat().st_size == 40 * 36
